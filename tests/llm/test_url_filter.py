import itertools
import math

import pytest
from pyspark.sql import functions as F

from thalweg.llm import url_filter as uf

AT = "/root/testdata/sf0.01"


def plain(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    ends = [i for i, c in enumerate(rest) if c in "/?#"]
    host = rest[: ends[0]] if ends else rest
    path = rest[ends[0] :] if ends else ""
    cut = [i for i, c in enumerate(path) if c in "?#"]
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), path[: cut[0]] if cut else path


def plain_rule(host, path):
    best = None
    for text, says in uf.RULES:
        name, _, rest = text.partition("/")
        if (host == name or host.endswith("." + name)) and path.startswith("/" + rest) and (best is None or len(text) > len(best[0])):
            best = (text, says)
    return best


def test_rules_against_plain_code(spark):
    odd = [None, "", "no url", "http://", "http://COM/", "https://a.b.example.com/en/x?y#z", "x://www.example.com/en/", "http://a.www.example.com/en/1",
           "http://example.com/en", "ftp://x.net/es/", "http://y.net/FR/", "a\nhttp://q.net/fr/\n?", "http://Ü.com/", "http://a.com?u=http://b.net/es/", "http://xcom/"]
    pages = spark.read.parquet(f"{AT}/pages.parquet").select("page_id", "url", "html").unionByName(
        spark.createDataFrame([(10_000 + i, u, None) for i, u in enumerate(odd)], "page_id long, url string, html string")
    ).withColumn("host", F.lit(1)).withColumn("verdict", F.lit("x"))
    urls = {r["page_id"]: r["url"] for r in pages.collect()}
    got = uf.judge(pages).collect()
    assert len(got) == len(urls)
    for r in got:
        host, path = plain(urls[r["page_id"]])
        assert (r["host"], r["path"]) == (host, path), urls[r["page_id"]]
        rule = plain_rule(host, path)
        assert r["rule"] == (rule[0] if rule else None)
        assert r["verdict"] == (rule[1] if rule else ("block" if r["score"] > 0.5 else "allow"))


def test_segmentation_is_the_best_of_all():
    s = uf.Segmenter({"the": 50, "river": 9, "rive": 1, "head": 5, "thee": 1, "ri": 3}, 1000)
    name = "theriverhead"
    every = []
    for cuts in itertools.product([0, 1], repeat=len(name) - 1):
        at = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(name)]
        every.append([name[a:b] for a, b in zip(at, at[1:])])
    assert s.split(name) == min(every, key=lambda w: sum(map(s.cost, w))) == ["the", "river", "head"]
    assert s.split("") == []
    long = "a" * 30
    assert uf.Segmenter({"book": 3, long: 50}, 1000).split("book" + long + "zz") == ["book", long, "zz"]
    assert uf.Segmenter({}, 0).split("q" * 90) == ["q" * 90]


def test_model_learns_words_and_judges_the_rest(spark):
    rows = [(i, f"http://{h}.{t}/{p}/{i}", "good river stone bad spam <b>river</b>") for i, (h, t, p) in enumerate(
        [("goodriver", "com", "a"), ("stoneriver", "com", "a"), ("badspam", "net", "es"), ("spambad", "net", "fr")] * 20
        + [("rivergood", "org", "a"), ("spamspam", "org", "a")])]
    got = {r["page_id"]: r for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[80]["verdict"] == "allow" and got[81]["verdict"] == "block"
    assert got[80]["host_words"] == "river good org"


def test_bayes_is_the_textbook_formula():
    import numpy as np

    counts = np.zeros((2, uf.SLOTS))
    counts[0, 1], counts[1, 1], counts[1, 2] = 3, 1, 4
    b = uf.Bayes.of(counts, (3, 2))
    want = math.log(2 / 3) + math.log((1 + 1) / (5 + uf.SLOTS)) - math.log((3 + 1) / (3 + uf.SLOTS))
    assert b.score([1]) == pytest.approx(1 / (1 + math.exp(-want)))


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert uf.judge(empty).count() == 0
    one = spark.createDataFrame([(1, "http://x.org/", None), (1, "http://x.org/", None)], "page_id long, url string, html string")
    assert [r["verdict"] for r in uf.judge(one).collect()] == ["allow"] * 2


def test_rare_words_of_large_tables_stay_in_the_dictionary(spark):
    common = "common " * 20_000
    rows = [(i, "http://rareword.org/", common) for i in range(25)] + [(99, "http://zebraquokka9.rareword.org/7", "rare word <b>zebra</b> Quokka " + "x" * 30)]
    got = {r["page_id"]: r["host_words"] for r in uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: "rare word org" for i in range(25)} | {99: "zebra quokka 9 rare word org"}
    counts = {r["word"]: r["n"] for r in uf.dictionary(spark.createDataFrame(rows, "page_id long, url string, html string"), "html").collect()}
    assert counts == {"common": 500_000, "rare": 1, "word": 1, "zebra": 1, "quokka": 1, "x" * 30: 1}


def test_rules_own_tokens_are_not_learnt_from():
    assert uf.told(uf.RULES) == {"h:com", "h:example", "h:www", "h:net", "p:en", "p:es", "p:fr"}


def test_accuracy_on_hosts_kept_from_training(spark):
    import random

    rng = random.Random(8)
    good, bad = ["river", "stone", "meadow", "garden"], ["spam", "casino", "poker", "loan"]
    rows = []
    for i in range(240):
        side = i % 2
        name = "".join(rng.sample(bad if side else good, 2)) + rng.choice(["", "one", "two"])
        rows.append((i, f"http://{name}{i % 7}.{'net/es' if side else 'com'}/{i}", " ".join(good + bad + ["one", "two"]) * 20))
    share, n = uf.held_out(spark.createDataFrame(rows, "page_id long, url string, html string"))
    assert n >= 20 and share >= 0.95


def test_words_of_any_length_are_segments(spark):
    word = "lopado" * 6
    rows = [(0, f"http://old{word}shop.org/", f"the old {word} shop " * 5)]
    got = uf.judge(spark.createDataFrame(rows, "page_id long, url string, html string")).first()
    assert got["host_words"] == f"old {word} shop org"
