import random

import pytest
from pyspark.sql import functions as F

from thalweg.llm import line_dedup as ld


def norm(line):
    return line.strip(" \t\r").lower()


def shingles(line):
    return {line[i : i + ld.SHINGLE] for i in range(max(1, len(line) - ld.SHINGLE + 1))}


def brute(docs):
    """keep place of each place of a line that is not blank."""
    places = [(d, n, norm(x)) for d, t in docs.items() if t is not None for n, x in enumerate(t.split("\n")) if norm(x)]
    texts = sorted({p[2] for p in places})
    root = {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {t: shingles(t) for t in texts}
    for i, a in enumerate(texts):
        for b in texts[i + 1 :]:
            if min(len(sets[a]), len(sets[b])) >= 0.8 * max(len(sets[a]), len(sets[b])):
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                    root[find(a)] = find(b)
    keep = {}
    for d, n, t in places:
        r = find(t)
        keep[r] = min(keep.get(r, (d, n)), (d, n))
    return {(d, n): keep[find(t)] for d, n, t in places}


@pytest.fixture(scope="module")
def lines_docs():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 9))) for _ in range(400)]
    base = [[rng.choice(words) for _ in range(rng.randrange(12, 40))] for _ in range(30)]
    docs = {}
    for d in range(60):
        lines = []
        for _ in range(rng.randrange(1, 6)):
            line = list(rng.choice(base))
            if rng.random() < 0.5:
                line[rng.randrange(len(line))] = rng.choice(words)
            lines.append(" ".join(line) if rng.random() < 0.8 else "  " + " ".join(line).upper() + " ")
        docs[d] = "\n".join([*lines, "", "short", "x" * rng.randrange(1, 4)])
    return docs | {60: None, 61: "", 62: "\n \n", 63: "ÉÉ été 🎈 à la une des lignes bien longues"}


def test_against_brute_force(spark, lines_docs):
    df = spark.createDataFrame(list(lines_docs.items()), "doc_id long, text string")
    got = ld.near_duplicate_lines(df).collect()
    expected = brute(lines_docs)
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in got} == expected
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["keep_doc_id"], r["keep_line_no"])) for r in got)


def test_texts_keep_one_line_of_each_component(spark, lines_docs):
    df = spark.createDataFrame([(d, t, "en", "src0", len(t or "")) for d, t in lines_docs.items()], "doc_id long, text string, lang string, source string, n_chars long")
    df = df.withColumn("uid", F.lit("mine")).withColumn("line", F.lit(1)).withColumn("keep", F.lit(2))
    expected = brute(lines_docs)
    out = ld.drop_repeated_lines(df)
    assert out.columns == df.columns
    for r in out.collect():
        t = lines_docs[r["doc_id"]]
        want = None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if expected.get((r["doc_id"], n), (r["doc_id"], n)) == (r["doc_id"], n))
        assert r["text"] == want and r["n_chars"] == len(want or "")


def test_empty_and_repeated_rows(spark, make_docs):
    docs = make_docs(["one line here\nanother one"])
    assert ld.near_duplicate_lines(docs.limit(0)).count() == 0
    assert ld.near_duplicate_lines(docs.union(docs)).where("kept").count() == 2
    assert ld.drop_repeated_lines(docs.limit(0)).count() == 0
    got = sorted(r["text"] for r in ld.drop_repeated_lines(docs.union(docs)).collect())
    assert got == ["", "one line here\nanother one"]


def test_plan_stays_on_the_jvm(make_docs):
    plan = ld.near_duplicate_lines(make_docs(["a line", "b line"]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Arrow" not in plan


def test_large_families_are_compared_whole(spark):
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(3, 9))) for _ in range(600)]
    docs = {}
    for f, (n, most) in enumerate([(300, 1), (300, 2)]):
        base = [rng.choice(words) for _ in range(25)]
        for i in range(n):
            line = list(base)
            for _ in range(rng.randrange(1, most + 1)):
                line[rng.randrange(len(line))] = rng.choice(words)
            docs[1000 * f + i] = " ".join(line)
    got = ld.near_duplicate_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    expected = brute(docs)
    wrong = [r["doc_id"] for r in got if (r["keep_doc_id"], r["keep_line_no"]) != expected[r["doc_id"], r["line_no"]]]
    assert len(got) == len(expected) and not wrong, (len(wrong), sum(r["kept"] for r in got), len(set(expected.values())))


def test_bitmaps_never_rule_out_a_similar_pair(spark):
    lines = ["abcdefghij" * 3, "a", "the quick brown fox jumps over the lazy dog", "the quick brown fox jumps over the lazy cat", "éèêü " * 30]
    once = spark.createDataFrame(list(enumerate(lines)), "id long, norm string").selectExpr("id", "encode(norm, 'UTF-16BE') as wide")
    got = {r["id"]: r for r in ld.bitmaps(once).collect()}
    for i, a in enumerate(lines):
        assert got[i]["size"] == len(shingles(a))
        for j, b in enumerate(lines):
            off = sum(bin((got[i][f"w{k}"] ^ got[j][f"w{k}"]) & (1 << 64) - 1).count("1") for k in range(ld.LONGS))
            assert off <= len(shingles(a) ^ shingles(b))
            assert i == j or off > 0


def test_pairs_apart_in_one_family_are_all_found(spark):
    """Pairs at 0.99 within a family whose members are otherwise below the threshold of each other."""
    rng = random.Random(9)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(3000)]
    base = [rng.choice(words) for _ in range(60)]
    docs = {}
    for i in range(200):
        line = list(base)
        for _ in range(5):
            line[rng.randrange(60)] = rng.choice(words)
        docs[2 * i], docs[2 * i + 1] = " ".join(line), " ".join(line) + "q"
    got = ld.near_duplicate_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    expected = brute(docs)
    assert len(set(expected.values())) > 100
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in got} == expected


def test_long_lines_are_compared_as_rows(spark, monkeypatch):
    rng = random.Random(2)
    texts = [" ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(30)) for _ in range(6)]
    docs = {i: t for i, t in enumerate(texts + [t[:-9] + "zzz" for t in texts] + ["short one", "short one!"])}
    monkeypatch.setattr(ld, "LONG", 40)
    got = ld.near_duplicate_lines(spark.createDataFrame(list(docs.items()), "doc_id long, text string")).collect()
    assert {(r["doc_id"], r["line_no"]): (r["keep_doc_id"], r["keep_line_no"]) for r in got} == brute(docs)


def test_hubs_join_every_band(spark, monkeypatch):
    monkeypatch.setattr(ld, "STAR", 4)
    met = spark.createDataFrame([(1, i, 0, 40) for i in range(40)] + [(2, 50, 50, 2), (2, 51, 50, 2)], "band long, id long, low long, n long")
    pairs = [(r["a"], r["b"]) for r in ld.hubs(met).collect()]
    root = {i: i for i in [*range(40), 50, 51]}

    def find(x):
        return x if root[x] == x else find(root[x])

    for a, b in pairs:
        root[find(b)] = find(a)
    assert len({find(i) for i in range(40)}) == 1 and find(50) == find(51) != find(0)
    assert max(sum(a == i for a, _ in pairs) for i in range(40)) < 25


def test_minima_are_those_of_every_place(spark):
    """Lines that end before, at and after the last place of a row of places."""
    rng = random.Random(4)
    lines = ["".join(rng.choice("abcdefghij") for _ in range(n)) for n in (1, 7, 8, 9, ld.RUN + 6, ld.RUN + 7, ld.RUN + 8, 3 * ld.RUN + 7, 500)]
    once = spark.createDataFrame(list(enumerate(lines)), "id long, norm string").withColumn("key", F.unhex(F.md5("norm")))
    got = {r["id"]: [r[f"m{i}"] for i in range(ld.MINIMA)] for r in ld.signatures(once).collect()}
    each = ld.shingle_rows(once.selectExpr("id", "encode(norm, 'UTF-16BE') as wide")).collect()
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    for k in range(len(lines)):
        hashes = [r["h"] for r in each if r["id"] == k]
        assert got[k] == [min(signed((h ^ ld._mask(i)) & (1 << 64) - 1) for h in hashes) for i in range(ld.MINIMA)]
