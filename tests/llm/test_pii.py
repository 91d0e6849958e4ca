import random
import re

from pyspark.sql import functions as F

from lattica.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(x) <= 255 for x in m[0].split(".")), "card": 13 <= len(d) <= 19 and luhn(d), "phone": 9 <= len(d) <= 15}[kind]
            if ok:
                out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_are_those_of_the_plain_patterns(spark):
    rnd = random.Random(3)
    frag = "a@b.co|x_y@d.e-f.g@h.i|1.2.3.4|1.2.3.4.5.6.7.8|256.1.1.1|0001.02.3.255| 4111 1111 1111 1111|4111-1111-1111-1111|+1 (017) 555-7713|+49 30 1234567 |😀é|\n| |word|@|.|%|-|+|5500005555555559".split("|")
    texts = ["".join(rnd.choice(frag) for _ in range(rnd.randint(0, 25))) for _ in range(700)]
    texts += [None, "", "1" * 100_000, "a" * 100_000, "a." * 20_000 + "@b" + ".c" * 20_000, "1 " * 30_000, "+1" + "2-" * 40_000 + "3"]
    df = spark.createDataFrame([*enumerate(texts), (None, "a@b.c"), (0, texts[0])], "doc_id long, text string").selectExpr("*", "1 as spans", "'x' as rid", "2 as base")
    got = pii.personal_data(df).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        assert [tuple(s) for s in r.base] == brute("a@b.c" if r.doc_id is None else texts[r.doc_id])
        assert [tuple(s) for s in r.spans][: len(r.base)] == [tuple(s) for s in r.base]


def test_disclosing_terms(spark):
    rows = [(i, f"Call Zaphod the day {a} at z@b.org today") for i, a in enumerate(("one", "two", "three", "four"))]
    rows += [(10, "zaphod was here"), (11, "the day"), (12, "the day"), (13, "Today the call is at one")] + [(20 + i, f"the day today call other{i}") for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: [(s.kind, s.start, s.stop) for s in r.spans] for r in pii.personal_data(df, disclosure=0.85).collect()}
    assert got[0] == [("email", 27, 34), ("term", 5, 11)] and got[10] == [("term", 0, 6)] and not any(got[i] for i in got if i > 10)
    clean = {r.doc_id: r.text for r in pii.sanitised(df, disclosure=0.85).collect()}
    assert clean[0] == "Call [TERM] the day one at [EMAIL] today" and clean[11] == "the day" and clean[10] == "[TERM] was here"
    assert {r.doc_id for r in pii.personal_data(df, min_contexts=9).collect() if len(r.spans) > len(r.base)} == set()


def test_sanitised_leaves_nothing_to_find(spark):
    rows = [(1, "a@b.c 1.2.3.4 +1 (017) 555-7713", 31), (2, None, None), (3, "clean", 5), (1, "a@b.c 1.2.3.4 +1 (017) 555-7713", 31), (None, "x@y.z", 5), (4, "a@b.c", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long").withColumn("__more", F.lit(1))
    out = pii.sanitised(df)
    assert out.columns == df.columns and out.count() == 6
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: ("[EMAIL] [IP] [PHONE]", 20), 2: (None, None), 3: ("clean", 5), None: ("[EMAIL]", 7), 4: ("[EMAIL]", 7)}
    assert pii.sanitised(df.limit(0)).count() == 0 and pii.personal_data(df.limit(0)).count() == 0
