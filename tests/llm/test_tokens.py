import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tickloom.llm import bpe_codec, packing, token_counts

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
ODD = [
    "",
    " ",
    "  two  spaces ",
    "a\n b",
    "a \n b",
    "a  b",
    "tab\t tab \t x",
    "it's 's we'll '' 'sx",
    "x<|endoftext|>y <|endoftext|> <|startoftext|>z",
    "nbsp   x   em　 \x1c \x85 next᠎ ",
    "é ́ combining ẛ̣",
    "中文 مرحبا नमस्ते 1²Ⅰ⁵",
    "\U0001f600\U0001f468‍\U0001f469 \U00020000",
    "İstanbul Σίσυφος STRASSE ẞ",
    "no" * 3000,
    "!?" * 2000 + " " * 50 + "end",
    "\n\n\n   \n",
    "word " * 700,
]
TEXT = st.text(st.characters(blacklist_categories=("Cs",)), max_size=60) | st.text(" \n\t'as1.<|endoftext>é ", max_size=60)


@pytest.fixture(scope="module")
def byte_level():
    return Tokenizer.from_file(BYTE)


@pytest.fixture(scope="module")
def proof():
    return token_counts.prove(BYTE)


@pytest.fixture(scope="module")
def coder():
    return packing.ByteLevelIds(BYTE)


@pytest.fixture(scope="module")
def codec():
    return bpe_codec.Codec(WORD)


def encoded(codec, texts):
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    return codec.encode(bpe_codec.chunked(np.frombuffer(b"".join(raw), np.uint8), offsets))


def test_counts_match_the_library(byte_level, proof):
    assert proof.shortcut and " the" in proof.single and len(proof.single) > 40_000
    want = [len(e.ids) for e in byte_level.encode_batch(ODD, add_special_tokens=False)]
    assert token_counts.Counter(proof).counts(ODD) == want


def test_other_vocabularies_are_counted_by_their_library():
    import sentencepiece

    texts = ["Hello world", "", "a b c"]
    model = public_tokenizers.path("piece_bpe_32k.model")
    want = [len(i) for i in sentencepiece.SentencePieceProcessor(model_file=model).encode(texts)]
    assert token_counts.Counter(token_counts.prove(model)).counts(texts) == want
    want = [len(e.ids) for e in Tokenizer.from_file(WORD).encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(token_counts.prove(WORD)).counts(texts) == want


@settings(max_examples=120, deadline=None)
@given(texts=st.lists(TEXT, min_size=1, max_size=4))
def test_any_text(byte_level, proof, coder, codec, texts):
    ids = [e.ids for e in byte_level.encode_batch(texts, add_special_tokens=False)]
    assert token_counts.Counter(proof).counts(texts) == [len(i) for i in ids]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == ids
    want = [e.ids for e in codec.tokenizer.encode_batch(texts, add_special_tokens=False)]
    got = encoded(codec, texts)
    assert [[int(i) for i in c.ids.split()] for c in got] == want
    assert [codec.decoded(c) for c in got] == codec.tokenizer.decode_batch(want, skip_special_tokens=False)


def test_ids_and_codec_on_odd_texts(byte_level, coder, codec):
    ids = [e.ids for e in byte_level.encode_batch(ODD, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(ODD)] == ids
    want = [e.ids for e in codec.tokenizer.encode_batch(ODD, add_special_tokens=False)]
    got = encoded(codec, ODD)
    assert [c.n for c in got] == [len(i) for i in want]
    assert [codec.decoded(c) for c in got] == [codec.tokenizer.decode(i, skip_special_tokens=False) for i in want]


def test_memo_overflow_changes_nothing(byte_level, proof, codec, monkeypatch):
    monkeypatch.setattr(token_counts, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 5)
    monkeypatch.setattr(bpe_codec, "CHUNK_MEMO", 2)
    monkeypatch.setattr(bpe_codec, "PIECE_MEMO", 3)
    ids = [e.ids for e in byte_level.encode_batch(ODD, add_special_tokens=False)]
    counter, coder, small = token_counts.Counter(proof), packing.ByteLevelIds(BYTE), bpe_codec.Codec(WORD)
    for text, i in zip(ODD, ids):
        assert counter.counts([text]) == [len(i)]
        assert np.frombuffer(coder.encode([text])[0], "<u4").tolist() == i
        assert encoded(small, [text])[0].n == encoded(codec, [text])[0].n


def test_white_space_before_a_special_string(byte_level, coder):
    texts = ["a\n\n<|endoftext|>", "a  <|endoftext|>b", "a \n<|endoftext|>\n\n<|endoftext|> c", "\n\n<|endoftext|>", "x\n\ny <|endoftext|"]
    assert byte_level.encode(texts[0], add_special_tokens=False).ids == [64, 628, 50256]
    ids = [e.ids for e in byte_level.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(b, "<u4").tolist() for b in coder.encode(texts)] == ids


def test_chunks_are_shared_and_whole():
    passage = " ".join(f"w{i * i}" for i in range(3000))
    texts = [f"first {passage} end", f"another start here {passage}"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    a, b = bpe_codec.chunked(np.frombuffer(b"".join(raw), np.uint8), offsets)
    assert [" ".join(c) for c in (a, b)] == texts
    assert len(set(a) & set(b)) > 5


def test_count_rows(odd_docs, no_docs, byte_level):
    out = token_counts.token_counts(odd_docs, BYTE)
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = sorted(map(tuple, out.collect()), key=str)
    texts = [(r["doc_id"], r["text"] or "") for r in odd_docs.collect()]
    want = [(i, len(t.encode()), n := len(byte_level.encode(t, add_special_tokens=False).ids), n > 512) for i, t in texts]
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(no_docs, BYTE).count() == 0


def test_codec_rows(odd_docs, no_docs, codec):
    got = sorted(map(tuple, bpe_codec.encode_decode(odd_docs, WORD).collect()), key=str)
    want = []
    for r in odd_docs.collect():
        ids = codec.tokenizer.encode(r["text"] or "", add_special_tokens=False).ids
        text = codec.tokenizer.decode(ids, skip_special_tokens=False)
        want.append((r["doc_id"], len(ids), *(hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), text))))
    assert got == sorted(want, key=str)
    assert bpe_codec.encode_decode(no_docs, WORD).count() == 0
    one = bpe_codec.encode_decode(odd_docs.where("doc_id = 8"), WORD, with_text=True).first()
    assert one["decoded"] == "one</w> two</w>"


def check_packed(rows, texts, tokenizer, capacity):
    """Every piece of every document once, its digest right, bins gapless and within the capacity."""
    want = []
    for doc, text in texts:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        want += [(doc, i, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for i, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted([tuple(r)[:5] for r in rows], key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for held in bins.values():
        end = 0
        for offset, length in sorted(held):
            assert offset == end
            end += length
        assert end <= capacity
    return len(bins)


def test_pack_rows(odd_docs, no_docs, byte_level):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = packing.pack_documents(odd_docs, BYTE, capacity=64).collect()
    bins = check_packed(rows, texts, byte_level, 64)
    assert bins == -(-sum(r["length"] for r in rows) // 64)
    assert packing.pack_documents(no_docs, BYTE).count() == 0


def brute_bins(pieces, capacity):
    """The fewest bins, by trying every place for every piece."""
    best = len(pieces)

    def place(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(pieces):
            best = len(bins)
            return
        for b in {room: j for j, room in enumerate(bins)}.values():
            if bins[b] >= pieces[i]:
                place(i + 1, bins[:b] + [bins[b] - pieces[i]] + bins[b + 1 :])
        place(i + 1, bins + [capacity - pieces[i]])

    place(0, [])
    return best


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_bin_completion_against_all_packings(pieces):
    counts = {p: pieces.count(p) for p in pieces}
    patterns = packing.bin_patterns(counts, 20)
    placed = {}
    for times, items in patterns:
        assert sum(a * k for a, k in items) <= 20
        for a, k in items:
            placed[a] = placed.get(a, 0) + times * k
    assert placed == counts
    assert sum(t for t, _ in patterns) <= brute_bins(sorted(pieces, reverse=True), 20) + 1


def test_completion_finds_the_full_filling():
    left = {3: 1, 5: 2, 6: 1, 7: 1}
    assert sum(a * k for a, k in packing.completion(13, sorted(left), left)) == 13
    assert packing.bin_patterns({}, 10) == []
    with pytest.raises(ValueError):
        packing.bin_patterns({11: 1}, 10)


def test_ended_searches_are_made_again():
    counts = {15: 1, 21: 1, 26: 1, 31: 1, 34: 1, 35: 1, 37: 2, 41: 1, 56: 1, 60: 1}
    report = {}
    patterns = packing.bin_patterns(counts, 100, nodes=8, report=report)
    assert sum(n for n, _ in patterns) == report["bins"] == report["bound"] == 4 and report["ended"] == 1
    placed = {}
    for n, items in patterns:
        assert sum(a * k for a, k in items) <= 100
        for a, k in items:
            placed[a] = placed.get(a, 0) + n * k
    assert placed == counts


def test_workers_let_go_of_what_others_kept(monkeypatch):
    """An operator that starts in a worker drops the memo of the one before it, not its own."""
    from tickloom.llm import frames

    monkeypatch.setattr(frames, "_KEPT", {})
    dropped = []
    double = lambda batches: (2 * b for b in batches)
    first, second = frames.lean(double, "first", lambda: dropped.append("first")), frames.lean(double, "second")
    assert list(first([1])) == [2] and list(first([2])) == [4] and not dropped
    assert list(second([3])) == [6] and dropped == ["first"] and not frames._KEPT


def test_batches_are_bounded_by_bytes(spark):
    from tickloom.llm import frames

    sizes = {"64m": 64 << 20, "67108864b": 64 << 20, "4096": 4096, "2k": 2048, "-1b": 1 << 62}
    assert {t: frames.size_in_bytes(t) for t in sizes} == sizes
    frames.small_batches(spark)
    assert frames.size_in_bytes(spark.conf.get(frames.BATCH_CONF)) <= frames.BATCH_BYTES


def test_pieces_that_come_back_are_learned_once(monkeypatch):
    """Words of one block only do not keep recurring ones out of a full memo; results are the library's."""
    monkeypatch.setattr(packing, "MEMO_ENTRIES", 40)
    monkeypatch.setattr(bpe_codec, "PIECE_MEMO", 40)
    monkeypatch.setattr(bpe_codec, "CHUNK_MEMO", 1)
    coder, codec = packing.ByteLevelIds(BYTE), bpe_codec.Codec(WORD)
    base, often, once = ([f"{name}{chr(97 + i)}" for i in range(n)] for name, n in (("base", 20), ("often", 15), ("once", 17)))
    asked: dict[str, list[set[str]]] = {"six": [], "nine": []}
    learn, learned = coder._learn, codec.learned
    coder._learn = lambda missing: asked["six"].append(set(missing)) or learn(missing)
    codec.learned = lambda missing: asked["nine"].append(set(missing)) or learned(missing)
    for block in range(5):  # what the first block alone holds fills the memo
        text = " ".join(["start", *base, *(often if block else once)])
        assert coder.encode([text]) == coder.whole([text])
        assert codec.encode([[text]]) == codec.library_codes([text])
    for calls in asked.values():
        assert sum(not missing.isdisjoint(often) for missing in calls) == 1
    assert max(len(coder.memo.of), len(codec.pieces.of)) <= 40
