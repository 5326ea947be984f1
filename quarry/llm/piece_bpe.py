"""SentencePiece BPE encoding and decoding by vectorised merge rounds.

A batch of texts becomes one byte array, cut into words in front of every run of
blanks (no piece of the vocabulary has a blank behind another character, so no
merge crosses such a cut; this is checked when the vocabulary is read). Each
distinct word of the batch is encoded once: the words' symbols lie in one flat
array, and every round finds the least pair rank of each word (segmented minimum),
merges its occurrences from the left at the same time, compacts the array and takes
out the words in which no pair is left. A merge that opens a pair as good as itself
ends its word's round, so the order of merges is that of the library's queue.
Characters outside the vocabulary become byte pieces.

Only batches of bounded size are in memory (a single longer text is its own batch).
The vocabulary's tables are sent to the tasks; their size is that of the model file.
Ids are packed as little-endian unsigned 32-bit integers, as training loaders read them.

Defined results: null and empty texts have only the begin and end ids and decode to the
empty text; repeated rows, missing doc_ids and very long texts are rows like others; an
empty table gives no rows; other columns are ignored. U+2581 in a text is a blank to
the library, and so it decodes to one.
"""

from __future__ import annotations

import codecs
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import byte_slices, text_slices

BATCH_BYTES = 2 << 20
MARK = "▁"               # the library's mark for a blank
BLANK = 0x20
SLOT_BITS = 18
NO_PAIR = np.iinfo(np.int32).max
ENCODED_SCHEMA = "doc_id bigint, n_tokens bigint, packed binary"
DECODED_SCHEMA = ENCODED_SCHEMA + ", decoded string"


class Vocabulary(NamedTuple):
    """Symbols are piece ids, then characters that occur only inside pieces."""

    symbol_of: np.ndarray     # per code point: its symbol, -1 if no piece has it
    n_pieces: int
    inner: np.ndarray         # code points of the symbols from n_pieces on
    pair: np.ndarray          # left symbol * stride + right symbol, ascending by slot
    slot: np.ndarray          # where each hash slot's pairs begin
    pair_rank: np.ndarray
    pair_symbol: np.ndarray
    stride: int
    opens: np.ndarray         # per rank: a merge may open a pair as good as itself
    byte_id: np.ndarray
    piece_bytes: np.ndarray   # of all pieces, blanks as blanks
    piece_first: np.ndarray
    begin: int
    end: int
    unknown: int
    blank_run: int            # blanks that make a piece of their own, 0: unknown


def read_vocabulary(path: str) -> Vocabulary:
    """Tables of a BPE model with byte fallback, a blank put in front of every text and
    no other normalisation; any other model is refused."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    n = model.vocab_size()
    probe = "  a Åﬁ ①　b\tc  "
    if model.normalize(probe) != (MARK + probe).replace(" ", MARK):
        raise ValueError("the model normalises texts; only escaped blanks with a blank in front are supported")
    byte_id = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], dtype=np.int32)
    if not all(model.is_byte(int(i)) for i in byte_id):
        raise ValueError("the model has no byte pieces")
    piece = {model.id_to_piece(i): i for i in range(n)
             if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))}
    if any(model.is_unused(i) for i in piece.values()):
        raise ValueError("unused pieces are not supported")
    if any(MARK in p.lstrip(MARK) for p in piece):
        raise ValueError("a piece has a blank behind another character")
    score = {p: -model.get_score(i) for p, i in piece.items()}
    rank_of = {s: r for r, s in enumerate(sorted(set(score.values())))}
    rank = {p: rank_of[s] for p, s in score.items()}
    inner = sorted({c for p in piece for c in p} - piece.keys())
    symbol = piece | {c: n + i for i, c in enumerate(inner)}
    stride = n + len(inner)
    pairs, opens = {}, np.zeros(len(rank_of) + 1, dtype=bool)
    for p, i in piece.items():
        for cut in range(1, len(p)):
            left, right = p[:cut], p[cut:]
            if left in symbol and right in symbol:
                pairs[symbol[left] * stride + symbol[right]] = (rank[p], i)
            for part in (left, right):
                if len(part) > 1 and part in rank and rank[p] <= rank[part]:
                    opens[rank[part]] = True
    keys = np.array(list(pairs), dtype=np.int64)
    keys = keys[np.argsort(_slot_of(keys), kind="stable")]
    symbol_of = np.full(0x110000, -1, dtype=np.int32)
    for c in symbol:
        if len(c) == 1:
            symbol_of[BLANK if c == MARK else ord(c)] = symbol[c]
    raw = [_bytes_of(model, i) for i in range(n)]
    v = Vocabulary(
        symbol_of, n, np.array([ord(c) for c in inner], dtype=np.int64), keys,
        np.searchsorted(_slot_of(keys), np.arange((1 << SLOT_BITS) + 1)),
        np.array([pairs[k][0] for k in keys.tolist()], dtype=np.int32),
        np.array([pairs[k][1] for k in keys.tolist()], dtype=np.int32), stride, opens, byte_id,
        np.frombuffer(b"".join(raw), dtype=np.uint8), np.cumsum([0] + [len(r) for r in raw]),
        model.bos_id(), model.eos_id(), model.unk_id(), 0)
    return v._replace(blank_run=_blank_run(v, rank))


def _bytes_of(model, i: int) -> bytes:
    if model.is_control(i):
        return b""
    if model.is_byte(i):
        return bytes([int(model.id_to_piece(i)[1:-1], 16)])
    return " ⁇ ".encode() if model.is_unknown(i) else model.id_to_piece(i).replace(MARK, " ").encode()


def _blank_run(v: Vocabulary, rank: dict[str, int]) -> int:
    """The longest run of blanks that is a piece, if a long run is taken from the left in
    pieces of that length and so may be cut there: all runs that are pieces have the same,
    last rank, blanks are doubled in no other piece, and runs of up to three times the
    length behave so. Else 0."""
    runs = {len(p) for p in rank if len(p) > 1 and p.strip(MARK) == ""}
    last = max(rank.values(), default=0)
    if not runs or any(MARK * 2 in p and p.strip(MARK) for p in rank) or any(rank[MARK * k] != last for k in runs):
        return 0
    k = max(runs)
    ids, first = encode_words(v, pa.array([b" " * m for m in range(3 * k + 1)], pa.large_binary()))
    taken = [ids[first[m]:first[m + 1]].tolist() for m in range(3 * k + 1)]
    return k if all(taken[m] == taken[k] + taken[m - k] for m in range(k + 1, 3 * k + 1)) else 0


def _slot_of(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


def _pair_index(v: Vocabulary, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Place of each pair in ``v.pair``, -1 if it is none."""
    key = left.astype(np.int64) * v.stride + right
    slot = _slot_of(key)
    at, end = v.slot[slot], v.slot[slot + 1]
    found = np.full(len(key), -1, dtype=np.int64)
    open_ = np.flatnonzero((at < end) & (left >= 0) & (right >= 0))
    while len(open_):
        here = at[open_]
        hit = v.pair[here] == key[open_]
        found[open_[hit]] = here[hit]
        at[open_] += 1
        open_ = open_[~hit & (here + 1 < end[open_])]
    return found


def _ranks(v: Vocabulary, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rank and merged symbol of the pairs that begin at ``at``."""
    nxt = np.minimum(at + 1, len(sym) - 1)
    found = _pair_index(v, sym[at], sym[nxt])
    found[(word[at] != word[nxt]) | (at == nxt)] = -1
    hit = found >= 0
    return np.where(hit, v.pair_rank[found], NO_PAIR).astype(np.int32), np.where(hit, v.pair_symbol[found], -1)


def merge_rounds(v: Vocabulary, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``sym``: symbols of all words one after another (negative: unknown characters),
    ``word``: their words, ascending. Returns both once no pair is left."""
    ended_sym, ended_word = [], []
    rank, into = _ranks(v, sym, word, np.arange(len(sym))) if len(sym) else (sym, sym)
    while len(sym):
        first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        size = np.diff(np.append(first, len(sym)))
        best = np.minimum.reduceat(rank, first)
        live = best < NO_PAIR
        if not live.all():
            on = np.repeat(live, size)
            ended_sym.append(sym[~on])
            ended_word.append(word[~on])
            sym, word, rank, into = sym[on], word[on], rank[on], into[on]
            best, size = best[live], size[live]
            if not len(sym):
                break
        hit = np.flatnonzero(rank == np.repeat(best, size))
        # pairs that overlap: from the left, every second one of a run
        place = np.arange(len(hit))
        begins = np.concatenate([[True], hit[1:] != hit[:-1] + 1])
        hit = hit[(place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0]
        hit = _in_order(v, sym, word, rank, into, hit)
        sym[hit] = into[hit]
        keep = np.ones(len(sym), dtype=bool)
        keep[hit + 1] = False
        at = np.cumsum(keep)[hit] - 1
        sym, word, rank, into = sym[keep], word[keep], rank[keep], into[keep]
        touched = np.zeros(len(sym), dtype=bool)
        touched[at] = touched[np.maximum(at - 1, 0)] = True
        at = np.flatnonzero(touched)
        rank[at], into[at] = _ranks(v, sym, word, at)
    if not ended_sym:
        return sym, word
    sym, word = np.concatenate(ended_sym), np.concatenate(ended_word)
    order = np.argsort(word, kind="stable")
    return sym[order], word[order]


def _in_order(v: Vocabulary, sym, word, rank, into, hit: np.ndarray) -> np.ndarray:
    """The merges of this round: those of a word up to the first that opens a pair as
    good as itself (that pair comes before the rest)."""
    if not v.opens[rank[hit]].any():
        return hit
    left = np.maximum(hit - 1, 0)
    before = sym[left].copy()
    joined = np.concatenate([[False], hit[1:] == hit[:-1] + 2])      # its left neighbour was merged too
    before[joined] = into[hit[np.flatnonzero(joined) - 1]]
    right = np.minimum(hit + 2, len(sym) - 1)
    opened = np.full(len(hit), NO_PAIR, dtype=np.int32)
    for a, b, real in ((before, into[hit], (hit > 0) & (word[left] == word[hit])),
                       (into[hit], sym[right], (hit + 2 < len(sym)) & (word[right] == word[hit]))):
        found = np.where(real, _pair_index(v, a, b), -1)
        opened = np.minimum(opened, np.where(found >= 0, v.pair_rank[found], NO_PAIR))
    stops = opened <= rank[hit]
    w = word[hit]
    new = np.concatenate([[True], w[1:] != w[:-1]])
    earlier = np.cumsum(stops) - stops                                 # stops in front of this one
    return hit[earlier == np.maximum.accumulate(np.where(new, earlier, 0))]


def _word_starts(data: np.ndarray, first: np.ndarray, run: int) -> np.ndarray:
    """Byte positions at which words begin: texts, runs of blanks, and every ``run``
    blanks inside a run."""
    blank = data == BLANK
    fresh = np.zeros(len(data), dtype=bool)
    fresh[1:] = blank[1:] & ~blank[:-1]
    fresh[first] = True
    if run and len(data) > 1 and (blank[1:] & blank[:-1]).any():
        at = np.arange(len(data))
        begun = np.maximum.accumulate(np.where(fresh, at, 0))
        solid = np.maximum.accumulate(np.where(blank, -1, at))         # the last other byte
        inside = blank & (solid < begun)                               # still in the word's run of blanks
        fresh |= inside & ((at - begun) % run == 0)
    return np.flatnonzero(fresh)


def encode_words(v: Vocabulary, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of an Arrow array of words: ``(ids, first)``; word i has ``ids[first[i]:first[i + 1]]``."""
    n = len(words)
    joined = b"".join(words.to_pylist())
    code = np.frombuffer(joined.decode().encode("utf-32-le"), dtype=np.uint32).astype(np.int64)
    lead = (np.frombuffer(joined, dtype=np.uint8) & 0xC0) != 0x80      # the first byte of each character
    size = pc.binary_length(words).to_numpy(zero_copy_only=False)
    word = np.repeat(np.arange(n), size)[lead]
    sym = v.symbol_of[code].astype(np.int64)
    sym = np.where(sym >= 0, sym, -code - 1)
    sym, word = merge_rounds(v, sym, word)
    lone = (sym < 0) | (sym >= v.n_pieces)                             # no piece: its bytes
    if not lone.any():
        return sym.astype(np.int32), np.searchsorted(word, np.arange(n + 1))
    inner = np.append(v.inner, 0)
    code = np.where(sym < 0, -sym - 1, inner[np.clip(sym - v.n_pieces, 0, len(v.inner))])[lone]
    width = 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000)
    count = np.ones(len(sym), dtype=np.int64)
    count[lone] = width
    ids, word = np.repeat(sym, count), np.repeat(word, count)
    where = np.repeat(lone, count)
    raw = "".join(map(chr, code.tolist())).encode()
    ids[where] = v.byte_id[np.frombuffer(raw, dtype=np.uint8)]
    return ids.astype(np.int32), np.searchsorted(word, np.arange(n + 1))


def _spans(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Concatenated ranges ``first[i] .. first[i] + size[i] - 1``."""
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(first - (ends - size), size) + np.arange(total)


def encode_texts(v: Vocabulary, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Ids of whole texts (large strings without nulls) with begin and end ids: ``(ids, first)``."""
    texts = pc.replace_substring(texts, MARK, " ")
    full = pc.greater(pc.binary_length(texts), 0)
    texts = pc.if_else(full, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), texts,
                                                         pa.scalar("", pa.large_string())), texts)
    buffers, n = texts.buffers(), len(texts)
    off = np.frombuffer(buffers[1], dtype=np.int64)[texts.offset:texts.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[off[0]:off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    off = off - off[0]
    starts = _word_starts(data, off[:-1][np.diff(off) > 0], v.blank_run) if len(data) else np.zeros(0, np.int64)
    cuts = np.append(starts, len(data)).astype(np.int64)
    cells = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts),
                                             [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(data))])
    coded = cells.dictionary_encode()
    ids, first = encode_words(v, coded.dictionary) if len(starts) else (np.zeros(0, np.int32), np.zeros(1, np.int64))
    word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    size = np.diff(first)[word] if len(word) else np.zeros(0, np.int64)
    body = ids[_spans(first[word], size)] if len(word) else ids
    per_text = np.diff(np.concatenate([[0], np.cumsum(size)])[np.searchsorted(starts, off)])
    out_first = np.concatenate([[0], np.cumsum(per_text + 2)])
    out = np.empty(int(out_first[-1]), dtype=np.int32)
    inside = np.ones(len(out), dtype=bool)
    inside[out_first[:-1]] = inside[out_first[1:] - 1] = False
    out[out_first[:-1]], out[out_first[1:] - 1], out[inside] = v.begin, v.end, body
    return out, out_first


def _per_byte(error: UnicodeDecodeError) -> tuple[str, int]:
    return "�" * (error.end - error.start), error.end


codecs.register_error("one-mark-a-byte", _per_byte)


def decode_ids(v: Vocabulary, ids: np.ndarray, first: np.ndarray) -> list[str]:
    """Texts of id lists: control ids are silent, one blank in front is dropped, byte
    pieces that are no UTF-8 become U+FFFD byte by byte."""
    size = (v.piece_first[1:] - v.piece_first[:-1])[ids]
    raw = v.piece_bytes[_spans(v.piece_first[ids], size)] if len(ids) else np.zeros(0, np.uint8)
    bounds = np.concatenate([[0], np.cumsum(size)])[first]
    silent = size == 0
    texts = []
    whole = raw.tobytes()
    for i in range(len(first) - 1):
        a, b = int(bounds[i]), int(bounds[i + 1])
        said = first[i]
        while said < first[i + 1] and silent[said]:
            said += 1
        if a < b and whole[a] == BLANK and said < first[i + 1] and not _keeps_blank(v, ids[said]):
            a += 1
        texts.append(whole[a:b].decode("utf-8", "one-mark-a-byte"))
    return texts


def _keeps_blank(v: Vocabulary, i: int) -> bool:
    """Ids whose blank in front is their own: the byte of a blank, the unknown id."""
    return i == v.byte_id[BLANK] or i == v.unknown


def _packed(ids: np.ndarray, first: np.ndarray) -> pa.Array:
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first) - 1, [
        None, pa.py_buffer(first * 4), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary())


def _unpacked(packed: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    packed = pc.cast(packed, pa.large_binary())
    buffers, n = packed.buffers(), len(packed)
    off = np.frombuffer(buffers[1], dtype=np.int64)[packed.offset:packed.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[off[0]:off[-1]] if buffers[2] is not None else np.zeros(0, np.uint8)
    return np.frombuffer(data.tobytes(), dtype="<u4").astype(np.int32), (off - off[0]) // 4


def unpack(packed: Column) -> Column:
    """The ids of a packed column as an array."""
    @F.arrow_udf("array<int>")
    def ids(rows: pa.Array) -> pa.Array:
        flat, first = _unpacked(rows)
        return pa.ListArray.from_arrays(pa.array(first.astype(np.int32)), pa.array(flat))

    return ids(packed)


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, packed`` of every row's ``text``, begin and end ids included."""
    shared = docs.sparkSession.sparkContext.broadcast(tuple(read_vocabulary(model_path)))

    def run(batches):
        v = Vocabulary(*shared.value)
        for batch in batches:
            for row, texts in text_slices(batch.column(1), BATCH_BYTES):
                ids, first = encode_texts(v, texts)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(texts)), pa.array(np.diff(first)),
                                                  _packed(ids, first)], names=["doc_id", "n_tokens", "packed"])

    return docs.selectExpr("CAST(doc_id AS BIGINT) AS doc_id", "text").mapInArrow(run, ENCODED_SCHEMA)


def decode(coded: DataFrame, model_path: str) -> DataFrame:
    """``doc_id, n_tokens, packed, decoded`` of rows with ``doc_id, n_tokens, packed``."""
    shared = coded.sparkSession.sparkContext.broadcast(tuple(read_vocabulary(model_path)))

    def run(batches):
        v = Vocabulary(*shared.value)
        for batch in batches:
            for row, n in byte_slices(batch.column(2), BATCH_BYTES):
                part = batch.slice(row, n)
                said = pa.array(decode_ids(v, *_unpacked(part.column(2))), pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns, said], names=["doc_id", "n_tokens", "packed", "decoded"])

    return coded.select("doc_id", "n_tokens", "packed").mapInArrow(run, DECODED_SCHEMA)
