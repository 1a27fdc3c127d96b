import hashlib
import random
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from thalweg.llm import token_alignment as ta

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@lru_cache
def libraries():
    left, right = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    left.encode_special_tokens = True
    letters = ta.byte_level_alphabet()
    return left, right, {i: bytes(letters[c] for c in t) for t, i in left.get_vocab().items() if t != "<|endoftext|>"}


def tokens(texts):
    """Whole texts, token by token: lists of (id, first byte, end) on each side; none where a side does not spell the text."""
    left, right, names = libraries()
    out = []
    for t in texts:
        if not t:
            out.append(([], []))
            continue
        want, sides = (" " + t).encode(), []
        for ids, piece in ((left.encode(" " + t, add_special_tokens=False).ids, names.get), (right.encode(t), lambda i: bytes([int(right.id_to_piece(i)[3:5], 16)]) if right.is_byte(i) else right.id_to_piece(i).replace("▁", " ").encode())):
            at, side = 0, []
            for i in ids:
                side.append((i, at, at + len(piece(i))))
                at += len(piece(i))
            sides.append(side if b"".join(piece(i) for i in ids) == want else None)
        out.append(tuple(sides) if None not in sides else ([], []))
    return out


def brute(texts):
    both = tokens(texts)
    linked = [[(a[0], b[0]) for a in left for b in right if a[1] < b[2] and b[1] < a[2]] for left, right in both]
    holders = Counter(p for links in linked for p in set(links))
    top = {}
    for (a, _), n in holders.items():
        top[a] = max(top.get(a, 0), n)
    rows = []
    for (left, right), links in zip(both, linked):
        cuts = sorted({e for _, _, e in left} & {e for _, _, e in right})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for i, at, _ in side if low <= at < cut) for side in (left, right)))
            low = cut
        shown = ";".join(groups)
        rows.append((len(left), len(right), len(cuts), len(links), sum(holders[p] == top[p[0]] for p in links), sum(holders[p] for p in links), hashlib.sha256(shown.encode()).hexdigest() if left else ""))
    return rows


NAMES = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def check(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: tuple(r[c] for c in NAMES) for r in ta.align(df, A, B).collect()}
    assert [got[i] for i in range(len(texts))] == brute(texts)


HARD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a\n b", "a \tb c", "x\n\n\ny z", "don't we'll", "<|endoftext|> is text", "<s> x </s> <unk>", "▁a b▁c", "é è́ ﬁx 漢字 🙂 🇫🇷",
    " a   b", "a  b 　c", "\x00 \x1f \x7f", "<0x41> <0x0A>", "aaaa" * 300, " ".join(["the cat"] * 200), "the cat", "the cat", "1234567890 12 3", "a\u0085b \u0085 c",
]


def test_hard_texts_against_brute_force(spark):
    check(spark, HARD)


def test_documents_in_small_blocks(spark, small_docs, monkeypatch):
    texts = [r["text"] for r in small_docs.orderBy("doc_id").limit(70).collect() if r["text"] is None or len(r["text"]) < 3000]
    for size in (ta.BLOCK_CHARS, 500):
        monkeypatch.setattr(ta, "BLOCK_CHARS", size)
        check(spark, [*texts, *HARD])


def test_blocks_share_a_bounded_memory(monkeypatch):
    monkeypatch.setattr(ta, "MEMO_UNITS", 3)
    units = ta.Units(ta._pair(A, B))
    for texts in (["one two three four"], ["five"], ["▁bad", "one"]):
        ta._block(0, [1] * len(texts), texts, units, False)
    assert len(units.number) <= 4


@settings(deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("ab \n\té▁<|>x's1  🙂"), max_size=25), min_size=1, max_size=4))
def test_cutting_at_lone_spaces_changes_nothing(texts):
    units = ta.Units(ta._pair(A, B))
    found = ta._block(0, list(range(len(texts))), texts, units, True)
    got = [tuple(r) for r in found.loc[~found["head"], ["n_a", "n_b", "n_groups", "n_links", "groups_sha256"]].itertuples(index=False)]
    assert got == [(*r[:4], r[6]) for r in brute(texts)]


def test_bits():
    rng = random.Random(3)
    for size in (1, 63, 64, 65, 1000):
        one, two = (sorted(rng.sample(range(size), rng.randrange(size + 1))) for _ in range(2))
        a, b = ta.Bits.at(np.array(one, int), size), ta.Bits.at(np.array(two, int), size)
        assert (a & b).select().tolist() == sorted(set(one) & set(two)) and (a | b).select().tolist() == sorted(set(one) | set(two))
        assert a.rank(np.arange(size + 1)).tolist() == [sum(x < p for x in one) for p in range(size + 1)]


def test_pieces_across_spaces_are_not_cut():
    spec = {"pre_tokenizer": {"type": "ByteLevel", "use_regex": True, "add_prefix_space": False}, "normalizer": None}
    assert ta.separable(spec, ["▁a", "▁▁", "b"]) and not ta.separable(spec, ["▁a▁b"]) and not ta.separable(spec, ["a▁"])
    assert not ta.separable({**spec, "normalizer": {"type": "NFC"}}, ["a"]) and not ta.separable({"pre_tokenizer": None}, ["a"])


def test_empty_and_clashing_columns(spark, make_docs):
    docs = make_docs(["a b", None]).withColumn("block", F.lit("x")).withColumn("head", F.lit(1)).withColumn("pair", F.lit(2)).withColumn("n_docs", F.lit(2))
    found = {r["doc_id"]: r for r in ta.align(docs, A, B, with_groups=True).collect()}
    assert found[0]["n_a"] == 2 and found[0]["groups"].count("|") == 2 and found[1]["groups_sha256"] == ""
    assert ta.align(docs.limit(0), A, B).count() == 0
    twice = ta.align(make_docs(["a b"]).withColumn("doc_id", F.explode(F.array(F.lit(5), F.lit(5), F.lit(None)))), A, B).collect()
    assert [(r["n_links"], r["count_sum"]) for r in twice] == [(2, 6)] * 3


@pytest.mark.parametrize("text", ["long " * 5000, "x" * 20000])
def test_long_text(spark, text):
    check(spark, [text[: 2000], text[: 1990] + "y"])
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert ta.align(df, A, B).first()["n_a"] > 1000
