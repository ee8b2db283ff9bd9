import hashlib
import random
import re

from pyspark.sql import functions as F

from sparkseek.llm.secrets import BASE, EVERY, RULES, Rule, secrets, trigram_query

DATA = "/root/testdata/sf0.01/documents.parquet"


def plain(text, rules=RULES):
    out = []
    for n, (k, r) in enumerate(rules.items()):
        out += [(m.start(), n, k, m.end()) for m in re.finditer(r.pattern, text or "") if len(m[r.group]) >= r.least]
    return sorted(out)


def rendered(spans):
    return ",".join(f"{k}:{a}:{z}" for a, _, k, z in spans)


def expected(doc, text):
    spans = plain(text)
    base = [s for s in spans if s[2] in BASE]
    return (doc, *(sum(s[2] == k for s in spans) for k in BASE), hashlib.sha256(rendered(base).encode()).hexdigest(), rendered(spans), len(spans))


def planted(rng):
    run = lambda chars, n: "".join(rng.choice(chars) for _ in range(n))
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    word = rng.choice(["password", "PassWd", "SECRET", "token", "api_key", "ApiKey", "toke", "api__key"])
    parts = [
        word + rng.choice(["", '"', "'", "  "]) + rng.choice([":", " = ", "=", "==", " "]) + rng.choice(["", '"', "'"]) + run(alnum + "+/=._-", rng.randrange(12)),
        "AKIA" + run("ABCDEFGHIJ0123456789", rng.randrange(9, 15)),
        run("0123456789abcdef", rng.randrange(28, 36)),
        "gh" + rng.choice("opsux") + "_" + run(alnum, rng.randrange(34, 40)),
        "xox" + rng.choice("abpz") + "-" + run(alnum + "-", rng.randrange(14)),
        "AIza" + run(alnum, rng.randrange(33, 37)),
        rng.choice("rsq") + "k_live_" + run(alnum, rng.randrange(12, 20)),
        f"eyJ{run(alnum, 5)}.eyJ{run(alnum, 4)}.{run(alnum, 6)}",
        "-----BEGIN " + rng.choice(["", "RSA ", "rsa "]) + "PRIVATE KEY-----",
    ]
    return rng.choice(parts)


def test_equals_every_rule_on_every_text(spark):
    rng = random.Random(7)
    filler = ["word", "tok", "the Pass", "ékö 😀", "\n", "secret", "key=", "abcdef"]
    texts = ["".join(rng.choice([planted(rng), rng.choice(filler)]) + rng.choice(["", " ", "😀", "; "]) for _ in range(rng.randrange(0, 12))) for _ in range(600)]
    texts += [None, "", "token=" + "x" * 300_000, "é" * 200_000 + " AKIA" + "Z" * 20, "token=secret=abcdefgh token: secret= abcdefgh", "deadbeef " * 5000 + "f" * 32]
    docs = [(i, t) for i, t in enumerate(texts)] + [(5, texts[5])] * 3 + [(None, "token=abcdefgh1")] + [(9000 + i, "hot copy, token=0123456789") for i in range(500)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("h1", F.lit("a")).withColumn("held", F.lit("b")).repartition(4)
    got = sorted((tuple(r) for r in secrets(df).collect()), key=str)
    assert got == sorted((expected(d, t) for d, t in docs), key=str)
    assert all(any(k + ":" in r[5] for r in got) for k in RULES)


def test_queries_are_mandatory():
    rng = random.Random(8)
    assert trigram_query(RULES["access"].pattern) == {frozenset({"aki", "kia"})}
    assert trigram_query(RULES["hex"].pattern) == EVERY == trigram_query("(ab|c).*") == trigram_query("(abc)?x")
    assert trigram_query("(abc|ab[de]f)+") == {frozenset({"abc"}), frozenset({"abd", "bdf"}), frozenset({"abe", "bef"})}
    assert trigram_query("a.cde") == {frozenset({"cde"})} and trigram_query("(ab){2}") == {frozenset({"aba", "bab"})}
    assert {frozenset({"tok", "oke", "ken"}), frozenset({"sec", "ecr", "cre", "ret"})} < trigram_query(RULES["assign"].pattern)
    held = 0
    for _ in range(4000):
        text = planted(rng)
        for _, _, k, _ in plain(text):
            held += 1
            assert any(all(g in text.lower() for g in way) for way in trigram_query(RULES[k].pattern))
    assert held > 1000


def test_other_rules(spark):
    rules = {"id": Rule("ID-[0-9]{4}"), "any": Rule("[xyz]+", 0, 3), "pair": Rule("(k|key)=(a+)", 2, 2)}
    texts = ["ID-1234 xxyz key=aaa k=a", "id-1234 xy k=aa", "nothing"]
    got = {r.doc_id: r.spans for r in secrets(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), rules).collect()}
    assert got == {i: rendered(plain(t, rules)) for i, t in enumerate(texts)} and got[0].count(":") == 6


def test_native_and_empty(spark):
    docs = spark.read.parquet(DATA)
    plan = secrets(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(w in plan for w in ("Python", "Arrow", "Cartesian", "NestedLoop"))
    assert secrets(docs.where("false")).collect() == []
