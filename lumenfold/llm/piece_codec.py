"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies.

A text is normalised as the model says (a blank becomes U+2581, one more goes in front), cut into letters, and adjacent
symbols are merged: an agenda holds every adjacent pair whose join is a piece, the best score first, of equal scores
the leftmost; a merge puts the pairs with the new symbol's neighbours on the agenda, and entries whose symbols have
changed since are passed over. What can't be merged is looked up; a letter that is no piece becomes its UTF-8 bytes.

Where no piece holds U+2581 behind another sign (read off the vocabulary), no merge crosses from another sign to
U+2581, so a text's words are merged apart with the same result, and each different word of an Arrow batch once; up to
about ``WORDS`` short ones are remembered by a worker. The agendas of all new short words of a batch are worked off in step,
as arrays: each round takes every word's best pair. A word of over ``LONG_WORD`` letters has a heap of its own. Each word that is merged is encoded by the sentencepiece library too, in
the same batch; ``agrees`` says whether all of a text's words came out alike. Decoding is the library's decode.

The model (a bounded file, some hundred kB) is read by the driver, or given as bytes, and broadcast.

Defined cases: null and empty texts have no ids and decode to ''; a text of any length is encoded whole; repeated
rows give repeated rows; a null id among tokens is left out; other columns pass through, but for one called like an
output column, which that replaces. A vocabulary that isn't merge-type, or whose normaliser does more than mark blanks
(character maps, extra blanks, user-defined symbols), is refused with a ValueError.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from lumenfold.llm.sparkkit import read, small_batches

BLANK = "▁"
WORDS = 3 << 18
LONG_WORD = 64
#: Kinds of pieces and of models in the model file.
NORMAL, UNKNOWN, USER, BYTE = 1, 2, 4, 6
MERGES = 2


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = raw[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
            continue
        size = varint() if wire == 2 else 8 if wire == 1 else 4
        yield key >> 3, raw[at : at + size]
        at += size


class Vocabulary:
    """A merge-type model: ids and scores of its pieces, and how it marks blanks."""

    def __init__(self, model: bytes) -> None:
        import struct

        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.bytes: dict[int, int] = {}
        self.unknown, kind, fallback = 0, 1, 0
        norm = {3: 1, 4: 1, 5: 1, 2: b""}
        count = 0
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: b"\0\0\0\0", 3: NORMAL} | dict(_fields(value))
                text = piece[1].decode()
                if piece[3] == NORMAL:
                    self.ids[text], self.scores[text] = count, struct.unpack("<f", piece[2])[0]
                elif piece[3] == BYTE:
                    self.bytes[int(text[3:5], 16)] = count
                elif piece[3] == UNKNOWN:
                    self.unknown = count
                elif piece[3] == USER:
                    raise ValueError("user-defined symbols aren't supported")
                count += 1
            elif number == 2:
                spec = dict(_fields(value))
                kind, fallback = spec.get(3, 1), spec.get(35, 0)
            elif number == 3:
                norm |= dict(_fields(value))
        if kind != MERGES:
            raise ValueError("not a merge-type vocabulary")
        if norm[2] or norm[4] or not norm[5]:
            raise ValueError("the normaliser does more than mark blanks")
        if not fallback:
            self.bytes = {}
        self.front = BLANK if norm[3] else ""
        self.apart = not any(BLANK in p.lstrip(BLANK) for p in self.ids)
        # symbols as numbers: a piece by its id, a letter that is none by count + its code point
        self.count = count
        self.letter = np.arange(0x110000, dtype=np.int64) + count
        single = {p: i for p, i in self.ids.items() if len(p) == 1}
        self.letter[[ord(p) for p in single]] = list(single.values())
        number = lambda part: self.ids.get(part, count + ord(part) if len(part) == 1 else -1)
        self.span = count + 0x110000
        joins = {}
        for piece, i in self.ids.items():
            for at in range(1, len(piece)):
                a, b = number(piece[:at]), number(piece[at:])
                if a >= 0 and b >= 0:
                    joins[a * self.span + b] = i
        self.pairs = np.array(sorted(joins), np.int64)
        self.joined = np.array([joins[k] for k in self.pairs.tolist()], np.int64)
        self.worth = np.full(count + 1, -np.inf)
        self.worth[list(self.ids.values())] = [self.scores[p] for p in self.ids]

    def normal(self, text: str) -> str:
        return self.front + text.replace(" ", BLANK) if text else ""

    def merge(self, text: str) -> list[int]:
        """The ids of a normalised text, by the agenda."""
        scores = self.scores
        symbol: list[str | None] = list(text)
        n = len(symbol)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda: list[tuple[float, int, int, int]] = []

        def offer(a: int, b: int) -> None:
            joined = symbol[a] + symbol[b]
            if (score := scores.get(joined)) is not None:
                agenda.append((-score, a, b, len(joined)))

        for i in range(n - 1):
            offer(i, i + 1)
        heapq.heapify(agenda)
        while agenda:
            _, a, b, size = heapq.heappop(agenda)
            if symbol[a] is None or symbol[b] is None or len(symbol[a]) + len(symbol[b]) != size:
                continue
            symbol[a] += symbol[b]
            symbol[b] = None
            right[a] = after = right[b]
            if after < n:
                left[after] = a
            for x, y in ((left[a], a), (a, after)):
                if x >= 0 and y < n and (score := scores.get(joined := symbol[x] + symbol[y])) is not None:
                    heapq.heappush(agenda, (-score, x, y, len(joined)))
        out: list[int] = []
        for s in symbol:
            if s is None:
                continue
            known = self.ids.get(s)
            if known is not None:
                out.append(known)
            elif self.bytes:
                out += [self.bytes[b] for b in s.encode()]
            else:
                out.append(self.unknown)
        return out


    def _join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The pieces that pairs of symbols make, ``count`` where they make none."""
        key = a * self.span + b
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        return np.where(self.pairs[at] == key, self.joined[at], self.count) if len(self.pairs) else np.full(len(key), self.count)

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words end to end, how many each word has); as merge(), the words' agendas worked off in step."""
        sym = self.letter[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.fromiter(map(len, words), np.int64, len(words)))
        made = np.full(len(sym), self.count)
        pair = np.flatnonzero(word[1:] == word[:-1])
        made[pair] = self._join(sym[pair], sym[pair + 1])
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(sym):
            worth = self.worth[made]
            first = np.flatnonzero(np.diff(word, prepend=-1))
            size = np.diff(first, append=len(sym))
            best = np.maximum.reduceat(worth, first)
            live = np.repeat(best > -np.inf, size)
            done.append((word[~live], sym[~live]))
            at = np.flatnonzero(live & (worth == np.repeat(best, size)))
            at = at[np.diff(word[at], prepend=-1) > 0]  # the leftmost of equals
            sym[at] = made[at]
            live[at + 1] = False
            place = np.cumsum(live) - 1
            sym, word, made, at = sym[live], word[live], made[live], place[at]
            x = np.concatenate([at, at[at > 0] - 1])
            x = x[x + 1 < len(sym)]
            x = x[word[x] == word[x + 1]]
            made[x] = self._join(sym[x], sym[x + 1])
            ends = at[(at + 1 == len(sym)) | (word[np.minimum(at + 1, len(sym) - 1)] != word[at])]
            made[ends] = self.count
        word, sym = (np.concatenate(x) for x in zip(*done, strict=True)) if done else (np.zeros(0, np.int64),) * 2
        order = np.argsort(word, kind="stable")
        word, sym = word[order], sym[order]
        # letters that are no pieces become bytes, or the unknown piece
        odd = np.flatnonzero(sym >= self.count)
        spelled = {int(u): [self.bytes[b] for b in chr(u - self.count).encode()] if self.bytes else [self.unknown] for u in np.unique(sym[odd])}
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(spelled[u]) for u in sym[odd].tolist()]
        out = np.repeat(sym, size)
        out[np.repeat(sym >= self.count, size)] = list(chain.from_iterable(spelled[u] for u in sym[odd].tolist()))
        return out, np.bincount(word, weights=size, minlength=len(words)).astype(np.int64)


_WORD = re.compile(f"{BLANK}+[^{BLANK}]*|[^{BLANK}]+")


class Encoder:
    """A worker's encoder: remembers words, and compares each word it merges with the library."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.vocabulary = Vocabulary(model)
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}  # the word's place in what follows
        self.flat, self.size, self.odd = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, bool)

    def words(self, text: str) -> list[str]:
        text = self.vocabulary.normal(text)
        return _WORD.findall(text) if self.vocabulary.apart else [text] if text else []

    def _learn(self, new: list[str]) -> None:
        short = [w for w in new if len(w) <= LONG_WORD]
        flat, size = self.vocabulary.merge_all(short)
        long = [w for w in new if len(w) > LONG_WORD]
        more = [self.vocabulary.merge(w) for w in long]
        flat = np.concatenate([flat, *(np.array(m, np.int64) for m in more)])
        size = np.concatenate([size, np.array([len(m) for m in more], np.int64)])
        self.known.update(zip(short + long, range(len(self.size), len(self.size) + len(new)), strict=True))
        odd = self._differs(short + long, flat, size)
        self.flat, self.size, self.odd = np.concatenate([self.flat, flat.astype(np.int32)]), np.concatenate([self.size, size]), np.concatenate([self.odd, odd])

    def _differs(self, words: list[str], flat: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which words the library encodes in another way. It puts its own blank in front, so a word is asked for without one."""
        front = self.vocabulary.front
        asked = [w[len(front) :] for w in words]
        theirs = self.library.encode(asked, num_threads=1)
        their_size = np.fromiter(map(len, theirs), np.int64, len(theirs))
        their_flat = np.fromiter(chain.from_iterable(theirs), np.int64, their_size.sum())
        odd = their_size != size
        if odd.any():
            mine, own = flat[np.repeat(~odd, size)], their_flat[np.repeat(~odd, their_size)]
        else:
            mine, own = flat, their_flat
        odd[np.repeat(np.flatnonzero(~odd), size[~odd])[mine != own]] = True
        for i in np.flatnonzero(odd).tolist():
            if not words[i].startswith(front):
                odd[i] = False  # can't be asked for alone
            elif not asked[i]:
                # nor can a blank alone: of '' the library makes nothing, of ' ' two blanks
                odd[i] = self.vocabulary.merge(words[i] + BLANK) != self.library.encode(" ")
        return odd

    def batch(self, texts: list[str]) -> tuple[pa.ListArray, pa.BooleanArray]:
        """(ids, agrees) of each text."""
        cut = [self.words(t) for t in texts]
        counts = np.fromiter(map(len, cut), np.int64, len(cut))
        every = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.known.get, every, repeat(-1)), np.int64, len(every))
        missing = np.flatnonzero(at < 0)
        if len(missing):
            unknown = [every[i] for i in missing.tolist()]
            self._learn(list(dict.fromkeys(unknown)))
            at[missing] = np.fromiter(map(self.known.__getitem__, unknown), np.int64, len(unknown))
        begin, size = np.cumsum(self.size) - self.size, self.size[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        flat = self.flat[np.arange(ends[-1]) + np.repeat(begin[at] - ends[:-1], size)]
        edge = np.concatenate([[0], np.cumsum(counts)])
        wrong = np.concatenate([[0], np.cumsum(self.odd[at])])
        if len(self.known) > WORDS or len(self.flat) > 16 * WORDS:
            self._forget()
        return pa.ListArray.from_arrays(pa.array(ends[edge].astype(np.int32)), pa.array(flat)), pa.array(wrong[edge[1:]] == wrong[edge[:-1]])


@lru_cache(maxsize=2)
def _encoder(model: bytes) -> Encoder:
    return Encoder(model)


def encode(documents: DataFrame, model: bytes, text: str = "text") -> DataFrame:
    """The documents, their text column replaced by ids array<int> and agrees boolean."""
    spark = documents.sparkSession
    Vocabulary(model)  # refuses what isn't supported before any task runs
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in documents.columns if c not in (text, "ids", "agrees")]
    schema = documents.select(*rest).schema.add("ids", ArrayType(IntegerType())).add("agrees", "boolean")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value)
        for batch in batches:
            if batch.num_rows:
                ids, agrees = own.batch([t or "" for t in batch[text].to_pylist()])
                yield pa.record_batch([*[batch[c] for c in rest], ids, agrees], [*rest, "ids", "agrees"])

    return documents.select(*rest, text).mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> list[list[int]]:
    """An Arrow column of ids as lists; nulls in it are left out."""
    if column.null_count or column.values.null_count:
        return [[i for i in x or [] if i is not None] for x in column.to_pylist()]
    ends = column.offsets.to_pylist()
    flat = column.values[ends[0] : ends[-1]].to_numpy().tolist()
    return [flat[a - ends[0] : b - ends[0]] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def decode(tokens: DataFrame, model: bytes, ids: str = "ids") -> DataFrame:
    """The rows with their decoded text in the column ``decoded``."""
    spark = tokens.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(model)
    rest = [c for c in tokens.columns if c != "decoded"]
    schema = tokens.select(*rest).schema.add("decoded", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _encoder(shared.value).library
        for batch in batches:
            if batch.num_rows:
                texts = own.decode(_lists(batch[ids]), num_threads=1)
                yield pa.record_batch([*[batch[c] for c in rest], pa.array(texts, pa.string())], [*rest, "decoded"])

    return tokens.select(*rest).mapInArrow(run, schema)


def model_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def op12_sentencepiece(spark, sf_dir: str, path: str | None = None) -> DataFrame:
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("piece_bpe_32k.model")
    model = model_bytes(path)
    out = decode(encode(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model), model)
    listed = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"), "agrees")
