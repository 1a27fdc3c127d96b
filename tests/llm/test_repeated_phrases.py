import hashlib
import random
import re
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from thalweg.llm import repeated_phrases as rp

N = rp.LENGTH


def brute(texts):
    """Per text: (words, words removed, digest of what stays), from a count of all windows."""
    split = [re.findall(r"[^\x20\x09-\x0d]+", t or "") for t in texts]
    seen = Counter(tuple(w[i : i + N]) for w in split for i in range(len(w) - N + 1))
    out = []
    for w in split:
        gone = set()
        for i in range(len(w) - N + 1):
            if seen[tuple(w[i : i + N])] > 1:
                gone.update(range(i, i + N))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rp.remove(df).collect()}
    want = brute(texts)
    assert [got[i] for i in range(len(texts))] == want
    return want


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    word = lambda: rng.choice("the of and a to in is it so be as at or by we an".split() + [f"w{rng.randrange(300)}", "é", "漢字"])
    some = lambda n: [word() for _ in range(n)]
    shared = [some(n) for n in (33, 34, 35, 36, 52, 53, 70, 200)]
    out = []
    for _ in range(70):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            parts += some(rng.randrange(0, 60))
            if rng.random() < 0.75:
                s = list(rng.choice(shared))
                if rng.random() < 0.4:
                    s[rng.randrange(len(s))] = "Z"
                if rng.random() < 0.3:
                    s = s[rng.randrange(25) :]
                parts += s
        out.append(rng.choice([" ", "  ", "\n", "\t \x0b"]).join(parts))
    return out


HARD = [None, "", "  \n", "one", "x " * 34, "y " * 35, "z " * 36, "q " * 300, "a b " * 100, "p q r s t " * 30, " ".join(["n"] * 40), " ".join(f"v{i}" for i in range(35))]


def test_against_brute_force(spark, texts):
    want = check(spark, [*texts, *HARD, *HARD, texts[0], texts[0]])
    assert any(0 < n < total for total, n, _ in want)


def test_small_pieces_shards_and_groups(spark, texts, monkeypatch):
    for name, value in (("PIECE", 40), ("SHARD_WORDS", 150), ("SHARD_PIECES", 5), ("GROUP", 90)):
        monkeypatch.setattr(rp, name, value)
    check(spark, [*texts[:40], *HARD, " ".join(texts[:20])])


def test_form_letters(spark):
    """One phrase between ever other words: its seed stands in many passages."""
    rng = random.Random(4)
    form = [f"f{i}" for i in range(20)]
    letters = [" ".join([f"l{rng.randrange(9)}" for _ in range(30)] + form + [f"r{rng.randrange(9)}" for _ in range(30)]) for _ in range(60)]
    check(spark, [*letters, *letters[:30], *[x[: len(x) // 2 + 60] for x in letters[20:40]]])


def test_words_that_share_a_letter_stay_apart():
    rows = [(1, 0, b" ".join(b"w%d" % i for i in range(60)))]
    machine = rp.Automaton(rows, _One())
    assert machine.stretches(2, 0, [b"v%d" % i for i in range(60)]) == []
    assert machine.stretches(2, 0, [b"w%d" % i for i in range(10, 50)] + [b"x"] * 5) == [(0, 40)]
    machine = rp.Automaton(rows, rp._Letters())
    assert machine.stretches(2, 0, [b"w%d" % i for i in range(10, 50)] + [b"x"] * 5) == [(0, 40)]
    assert machine.stretches(1, 0, rows[0][2].split()) == [] and machine.covered[0].sum() == 40


@pytest.mark.parametrize("tried", [0, 5, 1000])
def test_a_seed_in_many_passages(monkeypatch, tried):
    """Looked up by the windows around it, or tried one by one: the same stretches."""
    monkeypatch.setattr(rp, "TRIED", tried)
    form = [b"f%d" % i for i in range(18)]
    rest = [[b"r%d" % (i % 7 * 100 + k // (1 + i % 3)) for k in range(60)] for i in range(40)]
    machine = rp.Automaton([(i, 0, b" ".join(form + r)) for i, r in enumerate(rest)], rp._Letters())
    for i in (0, 3, 17, 39):
        words = [b"x"] * 3 + form + rest[i][:20] + [b"y"] * 9 + rest[i][10:58]
        assert sorted({(a, b) for a, b in machine.stretches(99, 0, words) if b - a >= 38}) == sorted({(3, 41), (50, 98)})


class _One(dict):
    def __missing__(self, word):
        return "\U00010000"


def test_long_text(spark):
    rng = random.Random(9)
    words = [f"w{rng.randrange(4000)}" for _ in range(30_000)]
    again = words[5000:5100] + words[100:9000] + ["end"] + words[20_000:20_036]
    check(spark, [" ".join(words), " ".join(again), " ".join(words[:50])])


def test_small_documents(spark, small_docs):
    check(spark, [r["text"] for r in small_docs.orderBy("doc_id").limit(150).collect()])


def test_empty_and_clashing_columns(spark, make_docs):
    docs = make_docs(["q " * 50, None]).withColumn("uid", F.lit("x")).withColumn("z", F.lit(1)).withColumn("span", F.lit(2)).withColumn("shard", F.lit(2))
    found = {r["doc_id"]: r for r in rp.remove(docs, with_text=True).collect()}
    assert found[0]["n_removed"] == 50 and found[0]["kept"] == "" and found[1]["n_words"] == 0
    assert rp.remove(docs.limit(0)).count() == 0
    twice = make_docs([" ".join(f"u{i}" for i in range(40))]).withColumn("doc_id", F.explode(F.array(F.lit(5), F.lit(5), F.lit(None))))
    assert [r["n_removed"] for r in rp.remove(twice).collect()] == [40] * 3


def test_sql_gives_the_same(spark, texts):
    some = [*texts[:25], *HARD]
    db = duckdb.connect()
    db.execute("create table documents (doc_id bigint, text varchar)")
    db.executemany("insert into documents values (?, ?)", list(enumerate(some)))
    assert [tuple(r[1:]) for r in sorted(db.execute(rp.ORACLE_SQL).fetchall())] == brute(some)
