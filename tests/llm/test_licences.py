import random
import re

from pyspark.sql import functions as F

from thalweg.llm import licences as lic


def plain(text, templates=lic.TEMPLATES, threshold=0.8):
    """Every unit with every template, without pruning."""
    pairs = lambda t: (lambda w: {(a, b) for a, b in zip(w, w[1:])})(re.findall(r"[^\W_]+", t.lower()))
    lines = (text or "").split("\n")
    units = {(i, 1) for i in range(len(lines))} | {(0, len(lines))}
    for i in range(len(lines)):
        if lines[i].strip() and (i == 0 or not lines[i - 1].strip()):
            n = 1
            while i + n < len(lines) and lines[i + n].strip():
                n += 1
            units.add((i, n))
    out = {}
    for first, n in units:
        s = pairs("\n".join(lines[first : first + n]))
        scores = [(2 * len(s & t) / (len(s) + len(t)), name) for name, t in ((name, pairs(x)) for name, x in templates) if s and t]
        good = sorted((-d, name) for d, name in scores if d >= threshold)
        if good:
            out[first, n] = (good[0][1], -good[0][0])
    return out


def test_against_comparison_with_every_template(spark):
    rng = random.Random(8)
    docs = []
    for i in range(150):
        lines = []
        for _ in range(rng.randrange(1, 8)):
            kind = rng.random()
            words = rng.choice(lic.TEMPLATES)[1].split()
            if kind < 0.5:
                for _ in range(rng.randrange(0, 3)):
                    words[rng.randrange(len(words))] = rng.choice(["the", "of the", "X", ""])
                text = " ".join(words)
                lines += [text] if rng.random() < 0.6 else re.sub(r"(.{40}\S*) ", r"\1\n", text).split("\n")
            else:
                lines.append(rng.choice(["", " ", "of the Software without any", "plain words of the day " * 5]))
        docs.append((i, "\n".join(lines)))
    got = {r["doc_id"]: r for r in lic.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for i, t in docs:
        want = plain(t)
        assert {(m["first_line"], m["lines"]): (m["license"], m["dice"]) for m in got[i]["matches"]} == want
        assert got[i]["n_matches"] == len(want)
        assert got[i]["dice"] == max((d for _, d in want.values()), default=0.0)


def test_notices_of_the_small_tables(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r["doc_id"]: r["license"] for r in lic.scan(docs).collect()}
    for r in docs.collect():
        names = {n for n, t in lic.TEMPLATES if t in r["text"].split("\n")}
        assert not names or got[r["doc_id"]] in names


def test_hard_cases(spark, make_docs):
    docs = make_docs([None, "", "mit", "Released under the MIT License." + " x" * 3, "a b " * 300_000, "Released under\nthe MIT License."]).withColumn("license", F.lit(1)).withColumn("matches", F.lit(1))
    got = {r["doc_id"]: r for r in lic.scan(docs).collect()}
    assert [got[i]["license"] for i in (0, 1, 2, 4)] == [None] * 4 and got[0]["dice"] == 0.0
    assert got[5]["license"] == "MIT" and got[5]["matches"][0]["lines"] == 2
    assert lic.scan(docs.limit(0)).count() == 0
    assert lic.scan(docs, templates=()).where("license is not null").count() == 0
    assert lic.scan(docs, templates=(("one", "mit"), ("none", "..."))).where("license is not null").count() == 0


def test_licences_within_running_text(spark, tmp_path):
    from thalweg.llm import catalog

    mit, bsd = lic.TEMPLATES[2][1], lic.TEMPLATES[-1][1]
    mit = mit.replace("conditions: The", "conditions:\n\nThe").replace("Software. THE SOFTWARE IS", "Software.\n\nTHE SOFTWARE IS")
    bsd = bsd.replace("met: ", "met:\n\n").replace("disclaimer. ", "disclaimer.\n\n", 1)
    assert mit.count("\n\n") == bsd.count("\n\n") == 2
    filler = "\n".join("some plain words of a longer text that goes on and on" for _ in range(200))
    long = " ".join(f"word{i}" for i in range(2000))
    docs = [
        (0, f"{long}\n\n{mit}\n\n{filler}", "MIT", 1),
        (1, f"{long}\n\n{bsd}\n\n{long}", "BSD-2-Clause", 1),
        (2, f"This package reads maps. Licensed under the MIT License. See the docs for more of it. {long}", "MIT", 1),
        (3, f"{long} Licensed under CC BY 4.0. {long} This work is licensed under the GNU General Public License, version 3. {long}", "CC-BY-4.0", 2),
        (4, f"{long}\nLicensed under the MIT License.\n{long}", "MIT", 1),
        (5, f"{long} under the License {filler}", None, 0),
    ]
    spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in catalog.queries()["op9_license_scan"](spark, str(tmp_path)).collect()}
    assert [(got[d[0]]["license"], got[d[0]]["n_matches"]) for d in docs] == [d[2:] for d in docs]
    assert all(got[i]["dice"] == 1.0 for i in range(5))


def test_best_window_against_all_windows():
    rng = random.Random(6)
    scanner = lic.Scanner()
    for _ in range(60):
        text = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(lic.TEMPLATES[:2] + lic.TEMPLATES[7:14])[1].split()
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(["the", "of the", "X", "under", ""])
            text += [rng.choice(["plain", "the", "license"]) for _ in range(rng.randrange(6))] + words
        w = lic.words(" ".join(text))
        pairs = list(map(" ".join, zip(w, w[1:])))
        scores = [lic.dice(set(pairs[a:b]), t) for a in range(len(pairs)) for b in range(a + 1, len(pairs) + 1) for _, _, t in scanner.sets]
        want = max((d for d in scores if d >= lic.THRESHOLD), default=0.0)
        assert max((m[1] for m in scanner.scan(" ".join(text), True)), default=0.0) == want
