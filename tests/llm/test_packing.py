import zlib
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenloom.llm.packing import Packing, balance, pack, pack_lengths
from lumenloom.llm.tokens import added_tokens, public_path, public_pattern, vocabulary


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60))
def test_every_id_lies_in_exactly_one_piece(lengths):
    tiers = (4, 8, 16)
    seen, short = defaultdict(list), 0
    for tier, pieces in pack_lengths(lengths, tiers):
        total = sum(n for _, _, n in pieces)
        assert pieces and total <= 16
        short += total not in tiers
        for doc, at, n in pieces:
            assert n > 0
            seen[doc] += range(at, at + n)
    assert short <= 1
    assert {d: sorted(v) for d, v in seen.items()} == {d: list(range(n)) for d, n in enumerate(lengths)}


def test_balance():
    steps = balance([5, 4, 3, 3, 3], 2)
    loads = [sum(n for n, s in zip([5, 4, 3, 3, 3], steps) if s == k) for k in range(2)]
    assert max(loads) - min(loads) <= 3


@pytest.mark.parametrize("text", ["", "  a  b\n\nc", " a b\n", "\n", "x \n y", "it's 12 3\nfoo_bar <|endoftext|>", "a <|endoftext|> b", "<|endoftext|><|endoftext|>\n x<|endoftext|> ", "<|endoftext| >", "\0a b", "tab\there", "a b c", "Ünï cødé " * 50])
def test_memo_gives_the_ids_of_the_whole_text(text):
    tokenizers = pytest.importorskip("tokenizers")
    whole = tokenizers.Tokenizer.from_file(public_path("byte_bpe_50k.json"))
    ids = whole.encode(text, add_special_tokens=False).ids
    vocab = vocabulary(public_path("byte_bpe_50k.tiktoken"), public_pattern(), added_tokens(public_path("byte_bpe_50k.json")))
    for _ in range(2):
        assert vocab.of(text) == b"".join(i.to_bytes(4, "little") for i in ids)


def test_pack_rows(spark):
    docs = spark.createDataFrame([(1, "a b c " * 900, 1), (2, None, 2), (2, "", 3), (None, "x", 4), (3, "word " * 40, 5), (3, "word " * 40, 5)], "doc_id long, text string, tier int")
    rows = pack(docs, Packing(task_docs=3, group_docs=2)).collect()
    vocab = vocabulary(public_path("byte_bpe_50k.tiktoken"), public_pattern())
    full = vocab.of("a b c " * 900) + (1).to_bytes(4, "little")
    one = sorted((r for r in rows if r.doc_id == 1), key=lambda r: r.start)
    assert one[0].doc_tokens == len(full) // 4 and sum(r.length for r in one) == len(full) // 4
    for r in one:
        assert r.ids_crc32 == zlib.crc32(full[4 * r.start : 4 * (r.start + r.length)])
    assert sum(r.length for r in rows if r.doc_id == 2) == 2
    ends = defaultdict(int)
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert ends[r.sequence_id] == r.offset
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 2048
    assert pack(docs.limit(0)).collect() == []


def test_equal_rows_spread_and_settings_change_nothing(spark):
    docs = spark.range(6000).selectExpr("cast(null as long) as doc_id", "'one text of several words' as text", "id as other")
    rows = pack(docs, Packing(task_docs=1000)).groupBy((F.shiftright("sequence_id", 32)).alias("task")).agg(F.countDistinct("sequence_id").alias("n"), F.sum("length").alias("tokens")).collect()
    assert len(rows) == 6 and max(r.tokens for r in rows) < 2 * min(r.tokens for r in rows)
    for n in ("4", "50"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        held = [r.n for r in pack(docs).groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
        assert sum(held) % 6000 == 0 and sum(n not in (256, 512, 1024, 2048) for n in held) <= 8
    spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_added_tokens_that_need_borders_are_refused(tmp_path):
    (tmp_path / "t.json").write_text('{"added_tokens": [{"id": 5, "content": "x", "single_word": true, "lstrip": false, "rstrip": false}]}')
    with pytest.raises(ValueError, match="single_word"):
        added_tokens(str(tmp_path / "t.json"))
