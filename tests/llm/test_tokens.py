"""Token counts against the library on whole texts."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import sentencepiece

from corpusloom.llm.tokens import PieceCounter, _packed_strings, _unpacked, _unpacked_strings, count_tokens

from .fixtures import documents, frame, odd, with_clashes

MODEL = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["▁▁ a▁b", "  two  spaces  ", "<s> </s> <unk> <0x0A>", "a\nb\tc\r\n d", "ﬁ ½ ™ é", " x　y", "​", "日本語 テキスト", "x" * 5000, " ", "▁", "a ▁ b", "\x00 \x01", "🙂🙂 é"]


def test_against_library(spark):
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = documents() + [(5000 + i, t, "en", "s", 1) for i, t in enumerate(ODD)] + odd()
    got = count_tokens(with_clashes(frame(spark, rows), "n_tokens n_bytes over_limit")).collect()
    want = [(d, len((t or "").encode()), len(lib.encode(t or "")), len(lib.encode(t or "")) > 4096) for d, t, *_ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert any(r.over_limit for r in got)


def test_blocks_of_few_characters(spark, monkeypatch):
    import corpusloom.llm.tokens as m

    monkeypatch.setattr(m, "BLOCK", 300)
    monkeypatch.setattr(m, "MOST_DOCS", 3)
    lib = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    hot = [(i, f"zqxv{i % 3} zqxv0 zqxv0 unseenword" * (i % 5), "en", "s", 1) for i in range(60)]
    got = {r.doc_id: r.n_tokens for r in count_tokens(frame(spark, hot, parts=3)).collect()}
    assert got == {d: len(lib.encode(t)) for d, t, *_ in hot}


def test_frequencies_of_a_block():
    counter, lib = PieceCounter(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL)
    assert counter.cuts
    texts = [t for _, t, *_ in documents()[:40]] + ODD
    b = counter.block(texts, 4)
    parts = b.parts.to_pylist()
    assert len(set(parts)) == len(parts) and not set(parts) & set(counter.known) and (np.diff(b.slot) >= 0).all()
    rows = zip(np.repeat(np.array(parts, object), b.per_part).tolist(), b.doc.tolist(), b.times.tolist(), strict=True)
    assert all(counter.cut(texts[doc]).count(p) == times for p, doc, times in rows)
    assert b.total(np.array(counter.counts(parts))).tolist() == [len(lib.encode(t)) for t in texts]


def test_packed_strings():
    parts = pa.array(["a", "", "é\x00", "日本"] * 3, pa.large_string()).slice(1, 10)
    lengths, data = _packed_strings(parts)
    assert _unpacked_strings(_unpacked(lengths), [data]).to_pylist() == parts.to_pylist()


def test_empty(spark):
    assert count_tokens(frame(spark, [], parts=1)).count() == 0


def test_blocks_do_not_depend_on_batches(monkeypatch):
    import corpusloom.llm.tokens as m

    monkeypatch.setattr(m, "BLOCK", 50)
    monkeypatch.setattr(m, "MOST_DOCS", 6)
    texts = ["x" * (7 * i % 23) for i in range(60)] + ["y" * 500, ""] + ["z"] * 20
    whole = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    cuts = [[b.column("doc_id").to_pylist() for b in m._blocks(whole.slice(lo, n) for lo in range(0, len(texts), n))] for n in (1, 3, 7, 1000)]
    assert cuts[0] == cuts[1] == cuts[2] == cuts[3] and sum(cuts[0], []) == list(range(len(texts)))
    assert all(len(c) == 1 or (sum(len(texts[i]) for i in c) <= 50 and len(c) <= 6) for c in cuts[0]) and not list(m._blocks(iter([])))


def test_rows_in_another_order_are_an_error(spark):
    """Blocks of the second scan hold other pre-tokens, as many as before: each text here is a block."""
    import pytest

    def turned(batches):
        rows = pa.Table.from_batches(batches)
        yield from rows.take(pa.array(np.random.default_rng().permutation(len(rows)))).to_batches(max_chunksize=1)

    rows = [(i, f"zqxv{i:03d}k " * 280_000, "en", "s", 1) for i in range(7)]
    docs = frame(spark, rows, parts=1).select("doc_id", "text").mapInArrow(turned, "doc_id long, text string")
    with pytest.raises(Exception, match="another order"):
        count_tokens(docs).collect()
