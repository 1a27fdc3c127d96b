import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as cp
from thalweg.llm import decontamination as dc
from thalweg.llm import language_id as lid

from .test_line_dedup import brute as brute_lines
from .test_simhash import brute_components, plain_fingerprint

AT = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """The result of every stage, each written and read again."""
    base = tmp_path_factory.mktemp("pipeline")
    docs, out = spark.read.parquet(f"{AT}/documents.parquet").limit(120), []
    docs.write.parquet(f"{base}/in")
    docs = spark.read.parquet(f"{base}/in")
    out.append(docs)
    for k, (_, stage) in enumerate(cp.STAGES):
        stage(spark, docs, AT).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
        out.append(docs)
    return out


def texts(df):
    return {r["doc_id"]: r["text"] for r in df.collect()}


def test_order_and_columns(stages):
    assert [name for name, _ in cp.STAGES] == ["language_id", "line_dedup", "simhash_dedup", "decontamination", "packing"]
    for df in stages[1:5]:
        assert df.schema == stages[0].schema


def test_language_stage_keeps_clean_documents(spark, stages):
    before, after = texts(stages[0]), texts(stages[1])
    model = lid.train(stages[0])
    ids = list(before)
    p = model.probabilities([before[i] for i in ids])
    assert set(after) == {i for i, row in zip(ids, p) if row.max() >= model.threshold and lid.has_letter(before[i])}
    assert len(after) >= 0.98 * len(before)


def test_line_stage_against_brute_force(stages):
    before, after = texts(stages[1]), texts(stages[2])
    keep = brute_lines(before)
    assert after == {i: "\n".join(x for n, x in enumerate(t.split("\n")) if keep.get((i, n), (i, n)) == (i, n)) for i, t in before.items()}


def test_near_duplicate_stage_against_brute_force(stages):
    before, after = texts(stages[2]), texts(stages[3])
    root = brute_components({i: plain_fingerprint(t) for i, t in before.items()})
    assert after == {i: t for i, t in before.items() if root[i] == i}


def test_decontamination_stage(spark, stages):
    before, after = texts(stages[3]), texts(stages[4])
    items = [r["text"] for r in spark.read.parquet(f"{AT}/benchmark.parquet").collect()]
    for i, t in before.items():
        w = dc.words(t)
        near = any(dc.best_stretch(x, w, dc.allowed(len(x))) for x in map(dc.words, items))
        assert (i in after) == (not near)


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path(cp.TOKENIZER))
    before = texts(stages[4])
    rows = stages[5].collect()
    size = {}
    for r in rows:
        size[r["doc_id"]] = size.get(r["doc_id"], 0) + r["length"]
    assert size == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in before.items()}
    used = len({r["sequence_id"] for r in rows})
    assert used <= -(-sum(size.values()) // 4096) + 1


HARD = [(901, "the same short line\nand another one"), (901, "the same short line\nand another one"), (902, None), (903, ""), (904, " \n\t"), (905, "1234 !!"), (None, "a text without an id that stays for itself"), (906, "x" * 50000)]


def test_stages_on_hard_rows(spark, tmp_path):
    """Nulls, empty texts, repeated rows, a very long word and columns with the stages' own names."""
    docs = spark.read.parquet(f"{AT}/documents.parquet").limit(40)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in HARD], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.select(*rows.columns).unionByName(rows.withColumn("n_chars", rows["n_chars"].cast(docs.schema["n_chars"].dataType)))
    for name in ("uid", "fp", "line", "keep", "hits", "__lines", "__gone", "__stay", "__keep", "accepted"):
        docs = docs.withColumn(name, docs["source"])
    docs.write.parquet(f"{tmp_path}/in")
    docs = spark.read.parquet(f"{tmp_path}/in")
    for k, (name, stage) in enumerate(cp.STAGES):
        after = stage(spark, docs, AT)
        if k < 4:
            assert after.columns == docs.columns, name
        after.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        kept = [r["doc_id"] for r in docs.select("doc_id").collect()]
        if name == "language_id":
            assert not {902, 903, 904, 905} & set(kept) and kept.count(901) == 2
        if name == "line_dedup":
            assert docs.count() == before.count()
        if name == "simhash_dedup":
            twice = [r["text"] for r in docs.where("doc_id = 901").collect()]  # the second one's lines went to the first
            assert len(set(twice)) == len(twice) and kept.count(None) == 1


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet(f"{AT}/documents.parquet").limit(0)
    for _, stage in cp.STAGES:
        assert stage(spark, docs, AT).count() == 0
