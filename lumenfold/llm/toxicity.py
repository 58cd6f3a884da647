"""Toxicity by a weighted finite-state pattern grammar.

The words of a clause (a run of words without a full stop, colon, semicolon, exclamation or question mark, bracket or line end, however long)
become symbols: insult, threat, the person spoken to, other persons, negation, report, copula, words that lead a
noun phrase or follow one, or any other word. Small transducers rewrite them, are composed, and run over the clause:

* negation: an insult or threat within three words of a negation becomes a denied one;
* report: after a reporting verb or an opening quotation mark they become reported ones;
* target: behind the person spoken to, with nothing but copulas, articles and the like between, or right before it, an insult is aimed
  ("you utter idiot"); a threat is aimed if a person follows within two words ("kill you", not "you kill time");
* predicate: an insult up to three words behind a copula or word of likeness ("they are trash");
* join: an insult within ``JOINED`` words of another one ("worthless scum");
* phrase: an insult that a determiner or preposition leads, or that one follows ("a clown", "idiot of").

Only matched clauses are scored: a match of these patterns gains the weight of its word plus the offset of its pattern.
Denied and reported matches gain nothing. An insult that nothing in its clause composes with is lone, and alone it gains nothing either;
it strengthens by ``HELP`` of its weight where the document has a firm match (any but a phrase) or two phrases, or, being at
least two, beside one phrase. A document with one phrase and less never gets more than ``LONE``. Clauses without a match count
against the document, at the rate by which matches are commoner in toxic text. The score is the logistic of the prior's
log odds plus all that.

All weights are learned from a bounded sample of labelled rows (``TRAIN_ROWS``, documented), near copies
thinned. Insult arcs are words and beginnings of words of ``HEADS`` bytes that are, or are at least twice, in toxic texts significantly
more often (``SIGNIFICANT``, a likelihood ratio that no arc of some 10^6 tried is expected to reach by chance) and have a rate
at least e^``MIN_WEIGHT`` times that in clean ones; an arc weighs the log of that ratio. The pattern offsets are log ratios of how often
each pattern is matched in toxic and clean texts, drawn to the starting values of ``OFFSETS`` while counts are
few. Some plain insults are arcs from the start, until the labels say otherwise. Scoring covers every row and whole texts.

Defined cases: null, empty and wordless texts get the prior's score; rows without a label, or whose id is
null, aren't learned from; an id with both labels is toxic; repeated rows get equal scores; with no labels only the
starting arcs count; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumenfold.llm.sparkkit import cut, map_arrow, read, without
from lumenfold.llm.textkit import _BYTE, _PLACE, ALNUM, LOWER, blocks, gram_hashes, gram_ok, mix, word_hashes, words

TRAIN_ROWS = 20_000
SIGNIFICANT = 30.0
MIN_WEIGHT = 3.0
MAX_WEIGHT = 6.0
MIN_SUPPORT = 5
HEADS = (4, 5, 6, 7)
THRESHOLD = 0.7
LONE = 0.5
HELP = 0.5
JOINED = 12
#: Matches of a pattern at which what is counted weighs as much as the starting offset.
DRAWN = 20
#: Share of the expected matches that a document may lack without its being held against it: documents differ in rate.
SLACK = 0.5

# The grammar's closed word classes.
INSULTS = "idiot moron stupid pathetic loser scum trash worthless disgusting clown imbecile bastard vermin dumm trottel abschaum arschloch wertlos ekelhaft stupide imbécile connard ordure minable idiota estúpido imbécil basura asqueroso".split()
THREATS = "kill hurt destroy beat burn shoot stab töten umbringen schlagen erschießen vernichten tuer frapper détruire brûler matar golpear destruir quemar".split()
TARGETS = "you your yours yourself u dich dir dein deine ihr euch euer tu te toi ton ta vous votre tú ti usted ustedes vosotros".split()
PERSONS = "he she they him her them his their er ihn ihm sie il elle eux lui él ella ellos ellas me us mich mir uns moi nous mí nosotros".split()
NEGATIONS = "not no never nor none isn aren wasn don doesn didn nicht kein keine keinen nie niemals ne pas jamais aucun aucune ni nunca tampoco jamás".split()
REPORTS = "said says say wrote writes called calls quoted claimed told sagte sagt schrieb schreibt nannte nennt behauptet dit disait écrit appelle dijo dice escribió llamó llama".split()
COPULAS = "is are am was were be been re s bin bist ist sind seid war waren es est sont êtes sommes était suis eres son sois soy era eran como like wie comme as".split()
LEADS = (
    "a an the this that these those some any all of by to with for from at on in and or both so too very just more such what "
    "der die das den dem des ein eine einen einem eines von zu mit für auf bei aus im am zum zur und oder so sehr nur auch mehr "
    "le la les un une des du de ce cet cette ces par pour avec dans sur à au aux et ou si très trop plus "
    "el los las una unos unas del este esta estos por para con en a al y o tan muy más"
).split()
FOLLOWS = (
    "of in on at for with from to by and or who that which than as "
    "der die das von zu mit für auf im am und oder als wie den des "
    "de du des la le les et ou qui que dans en pour avec par sur "
    "del el los y o con por para"
).split()
OFFSETS = {"aimed insult": 0.5, "predicate insult": 0.5, "joined insult": 0.5, "phrased insult": -0.5, "aimed threat": 0.0}
FIRM = OFFSETS.keys() - {"phrased insult"}
THREAT_WEIGHT = 3.0

QUOTES = (b'"', "“".encode(), "«".encode())
_BREAK = np.isin(np.arange(256), list(b".;:!?\n()"))


class Transducer:
    """A deterministic letter transducer: arcs (state, symbol) -> (state, output); others loop and copy."""

    def __init__(self, arcs: dict[tuple[str, str], tuple[str, str]], start: str = "0") -> None:
        self.arcs, self.start = arcs, start

    def step(self, state: str, symbol: str) -> tuple[str, str]:
        return self.arcs.get((state, symbol)) or self.arcs.get((state, "*"), (state, symbol))

    def run(self, symbols: list[str]) -> list[str]:
        state, out = self.start, []
        for s in symbols:
            state, made = self.step(state, s)
            out.append(s if made == "*" else made)
        return out


def compose(first: Transducer, second: Transducer, alphabet: list[str]) -> Transducer:
    """One machine that does what ``second`` does with the output of ``first``."""
    begin = f"{first.start}|{second.start}"
    arcs, todo, seen = {}, [(first.start, second.start)], {begin}
    while todo:
        a, b = todo.pop()
        for s in alphabet:
            a2, mid = first.step(a, s)
            b2, out = second.step(b, s if mid == "*" else mid)
            made = (s if mid == "*" else mid) if out == "*" else out
            name = f"{a2}|{b2}"
            arcs[f"{a}|{b}", s] = (name, made)
            if name not in seen:
                seen.add(name)
                todo.append((a2, b2))
    return Transducer(arcs, begin)


def _negation(reach: int = 3) -> Transducer:
    arcs = {(str(k), "N"): (str(reach), "*") for k in range(reach + 1)}
    for k in range(1, reach + 1):
        arcs[str(k), "*"] = (str(k - 1), "*")
        arcs[str(k), "insult"] = (str(k - 1), "denied insult")
        arcs[str(k), "threat"] = (str(k - 1), "denied threat")
    return Transducer(arcs)


def _within(marks: list[str], reach: int, made: dict[str, str]) -> Transducer:
    """Up to ``reach`` words behind a mark, symbols become what ``made`` says."""
    arcs = {(str(k), m): (str(reach), "*") for k in range(reach + 1) for m in marks}
    for k in range(1, reach + 1):
        arcs[str(k), "*"] = (str(k - 1), "*")
        for was, now in made.items():
            arcs[str(k), was] = (str(reach if was in marks else k - 1), now)
    return Transducer(arcs)


_PASSED = ("C", "D", "A", "DA", "N", "denied insult", "reported insult")  # what may stand between a person and the insult
_REPORT = Transducer({("0", "R"): ("1", "*"), ("1", "insult"): ("1", "reported insult"), ("1", "threat"): ("1", "reported threat")})
_TARGET = Transducer({("0", "T"): ("1", "*"), ("1", "*"): ("0", "*"), ("1", "insult"): ("1", "aimed insult"), ("1", "T"): ("1", "*")} | {("1", s): ("1", "*") for s in _PASSED})
_PREDICATE = _within(["C"], 3, {"insult": "predicate insult"})
_CALLED = _within(["T"], 1, {"insult": "aimed insult"})
_THREATENED = _within(["T", "P"], 2, {"threat": "aimed threat"})
_JOIN = _within(["insult", "aimed insult", "predicate insult", "joined insult"], JOINED, {"insult": "joined insult"})
_LED, _FOLLOWED = _within(["D", "DA"], 1, {"insult": "phrased insult"}), _within(["A", "DA"], 1, {"insult": "phrased insult"})
_ALPHABET = ["insult", "threat", "T", "P", "N", "R", "C", "D", "A", "DA", "O"]


def _composed(*machines: Transducer) -> Transducer:
    out = machines[0]
    for m in machines[1:]:
        out = compose(out, m, _ALPHABET)
    return out


_FORWARD = _composed(_negation(), _REPORT, _TARGET, _PREDICATE)
_BACKWARD = compose(_CALLED, _THREATENED, [*_ALPHABET, "aimed insult", "predicate insult", "denied insult", "reported insult", "denied threat", "reported threat"])


def matches(symbols: list[str]) -> list[str]:
    """What the grammar makes of a clause; mirrored machines see what stands further on. What is left an insult is lone."""
    made = _BACKWARD.run(_FORWARD.run(symbols)[::-1])[::-1]
    made = _JOIN.run(_JOIN.run(made)[::-1])[::-1]
    made = _FOLLOWED.run(_LED.run(made)[::-1])[::-1]
    return ["lone insult" if s == "insult" else s for s in made]


def _hash_of(word: str) -> int:
    data = LOWER[np.frombuffer(word.encode(), np.uint8)]
    return int(word_hashes(data, np.array([0]), np.array([len(data)]), ALNUM)[0])


def _heads(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(words, hashes) of beginnings of each length in HEADS, of the words longer than that."""
    for n in HEADS:
        long = np.flatnonzero(end - start > n)
        h = np.full(len(long), np.uint64(n * 0x9E3779B97F4A7C15 % 2**64))
        for j in range(n):
            h += _BYTE[data[start[long] + j]] * _PLACE[128 + j]
        yield long, mix(h)


@dataclass
class Model:
    """What is learned: the prior's log odds, insult arcs (hashes in order, weights), pattern offsets, and what a word without a match counts."""

    prior: float = -2.0
    arcs: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    offsets: dict[str, float] = field(default_factory=lambda: dict(OFFSETS))
    rate: float = 0.0

    @classmethod
    def of(cls, prior: float, arcs: dict[int, float], **more) -> Model:
        hashes = np.array(sorted(arcs), np.uint64)
        return cls(prior, hashes, np.array([arcs[h] for h in hashes.tolist()]), **more)

    def weigh(self, kinds: list[str], weights: list[float], n_words: int) -> float:
        """The log odds of a document with these matches."""
        total = self.prior - self.rate * n_words
        total += sum(max(0.0, w + self.offsets[k]) for k, w in zip(kinds, weights, strict=True) if k in self.offsets)
        firm, phrases, lone = any(k in FIRM for k in kinds), kinds.count("phrased insult"), kinds.count("lone insult")
        if firm or phrases > 1 or (phrases and lone > 1):
            return total + HELP * sum(w for k, w in zip(kinds, weights, strict=True) if k == "lone insult")
        return min(total, math.log(LONE / (1 - LONE))) if phrases else total


_GROUPS = [("A", FOLLOWS), ("D", LEADS), ("DA", [w for w in LEADS if w in FOLLOWS]), ("C", COPULAS), ("R", REPORTS), ("N", NEGATIONS), ("P", PERSONS), ("T", TARGETS), ("threat", THREATS)]
#: A word of several groups belongs to the last of them.
_CLOSED = {_hash_of(w): s for s, group in _GROUPS for w in group}
_THREATS = np.array(sorted(h for h, s in _CLOSED.items() if s == "threat"), np.uint64)


def _found(model: Model, texts: pa.Array) -> Iterator[tuple[int, int, list[tuple[int, int, str, float]]]]:
    """(row, words, matches as (first word and end of the clause, kind, weight)) of each text."""
    for begin, stop, data, offsets in blocks(texts):
        data = LOWER[data]
        start, end, first = words(data, offsets, ALNUM)
        out: list[list[tuple[int, int, str, float]]] = [[] for _ in range(stop - begin)]
        if len(start):
            h = word_hashes(data, start, end, ALNUM)
            gain = np.zeros(len(h))
            for at, x in ((slice(None), h), *_heads(data, start, end)):
                if len(model.arcs):
                    k = np.minimum(np.searchsorted(model.arcs, x), len(model.arcs) - 1)
                    gain[at] = np.maximum(gain[at], np.where(model.arcs[k] == x, model.weights[k], 0))
            hot = np.flatnonzero((gain > 0) | np.isin(h, _THREATS))
            if len(hot):
                breaks = np.r_[0, np.cumsum(_BREAK[data])]
                opens = np.r_[True, breaks[start[1:]] > breaks[end[:-1]]]
                opens[first[:-1][first[:-1] < len(start)]] = True
                opens = np.r_[np.flatnonzero(opens), len(start)]
                run = np.searchsorted(opens, hot, side="right") - 1
                lo, hi = opens[run], opens[run + 1]
                new = np.flatnonzero(np.r_[True, lo[1:] != lo[:-1]])
                doc = np.searchsorted(first, lo[new], side="right") - 1
                raw = data.tobytes()
                for a, b, d in zip(lo[new].tolist(), hi[new].tolist(), doc.tolist(), strict=True):
                    symbols, words_at = [], []
                    for j in range(a, b):
                        # a quotation mark reports too; it is a symbol of its own before its word
                        before = raw[end[j - 1] if j > first[d] else offsets[d] : start[j]]
                        if any(q in before for q in QUOTES):
                            symbols.append("R")
                            words_at.append(-1)
                        symbols.append("insult" if gain[j] > 0 else _CLOSED.get(int(h[j]), "O"))
                        words_at.append(j)
                    for j, kind in zip(words_at, matches(symbols), strict=True):
                        if kind.endswith(("insult", "threat")):
                            out[d].append((a - int(first[d]), b - int(first[d]), kind, float(gain[j]) if gain[j] > 0 else THREAT_WEIGHT))
        for d, rows in enumerate(out):
            yield begin + d, int(first[d + 1] - first[d]), rows


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def _sample(documents: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """(id, toxic, text) of the rows to learn from."""
    usable = labels.select(F.col("doc_id").cast("long").alias("id"), F.col("toxic").cast("int").alias("toxic")).filter("id is not null and toxic in (0, 1)").filter(~held_out("id"))
    usable = usable.groupBy("id").agg(F.max("toxic").alias("toxic"))
    there = usable.count()
    if there > rows:
        usable = usable.filter(F.pmod(F.xxhash64("id", F.lit("toxicity")), F.lit(1 << 31)) < int((1 << 31) * rows / there))
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(usable), F.col("doc_id") == F.col("id")).select("id", "toxic", "text")


def features(texts: pa.Array) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(row, words, kind, features, how often each occurs) of each text; near copies have one kind.

    kind stands for the three least five-word shingle hashes, or for all words of a text with fewer shingles.
    """
    for begin, _, data, offsets in blocks(texts):
        data = LOWER[data]
        start, end, first = words(data, offsets, ALNUM)
        h = word_hashes(data, start, end, ALNUM)
        shingle = np.where(gram_ok(first, len(h), 5), gram_hashes(h, 5), np.uint64(2**64 - 1)) if len(h) >= 5 else np.zeros(0, np.uint64)
        heads = [(np.searchsorted(at, first), x) for at, x in _heads(data, start, end)]
        for d in range(len(first) - 1):
            own = slice(first[d], first[d + 1])
            least = np.unique(shingle[own])[:3] if own.stop - own.start >= 7 else h[own]
            kind = int(gram_hashes(least, len(least))[0]) if len(least) else 0
            f, c = np.unique(np.concatenate([h[own], *(x[at[d] : at[d + 1]] for at, x in heads)]), return_counts=True)
            yield begin + d, own.stop - own.start, kind, f, c


def _ratio(p: Column, n: Column, pos: int, neg: int) -> Column:
    """The likelihood ratio statistic of p toxic and n clean texts among all with a feature."""
    share = (pos + 0.5) / (pos + neg + 1.0)
    of = lambda k, expected: F.when(k > 0, k * F.log(k / expected)).otherwise(0.0)
    return 2 * (of(p, (p + n) * share) + of(n, (p + n) * (1 - share)))


def chosen(c: dict[str, Column], pos: int, neg: int, w_pos: int, w_neg: int) -> tuple[Column, Column]:
    """(weight, fits) of a feature that is in p toxic and n clean of pos and neg texts (at least twice in p2 and n2), tp and tn times among w_pos and w_neg words."""
    weight = F.log((c["tp"] + 0.5) / (w_pos + 1.0)) - F.log((c["tn"] + 0.5) / (w_neg + 1.0))
    significant = (c["p"] >= MIN_SUPPORT) & (_ratio(c["p"], c["n"], pos, neg) >= SIGNIFICANT)
    repeated = (c["p2"] >= MIN_SUPPORT) & (_ratio(c["p2"], c["n2"], pos, neg) >= SIGNIFICANT)
    return F.least(weight, F.lit(MAX_WEIGHT)), (weight >= MIN_WEIGHT) & (significant | repeated)


def train(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> Model:
    texts = _sample(documents, labels, rows)

    def featured(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        cols = list(zip(*features(batch["text"]), strict=True))
        arrays = [pa.array(cols[1], pa.int64()), pa.array(np.array(cols[2], np.uint64).view(np.int64))]
        lists = [pa.array([x.view(np.int64) for x in cols[3]], pa.list_(pa.int64())), pa.array([x.astype(np.int32) for x in cols[4]], pa.list_(pa.int32()))]
        yield pa.record_batch([batch["id"], batch["toxic"], *arrays, *lists], ["id", "toxic", "words", "kind", "f", "c"])

    each = map_arrow(texts, featured, "id long, toxic int, words long, kind long, f array<long>, c array<int>")
    # of near copies the one of least id stays
    each = each.groupBy("toxic", "kind").agg(F.min_by(F.struct("id", "words", "f", "c"), "id").alias("r")).select("toxic", "r.*")
    each = cut(each)
    is_toxic = F.col("toxic") == 1
    total = each.agg(*(F.coalesce(F.sum(F.when(is_toxic if t else ~is_toxic, x)), F.lit(0)) for t in (True, False) for x in (F.lit(1), F.col("words")))).first()
    pos, w_pos, neg, w_neg = total
    prior = min(0.0, math.log((pos + 1) / (neg + 1))) if pos + neg else -2.0

    pair = F.explode(F.arrays_zip("f", "c")).alias("x")
    counts = each.select("toxic", pair).select("toxic", "x.f", "x.c").groupBy("f")
    toxic, clean, twice = F.col("toxic"), 1 - F.col("toxic"), (F.col("c") > 1).cast("int")
    sums = {"p": toxic, "n": clean, "p2": toxic * twice, "n2": clean * twice, "tp": toxic * F.col("c"), "tn": clean * F.col("c")}
    counts = counts.agg(*(F.sum(x).cast("double").alias(k) for k, x in sums.items()))
    weight, fits = chosen({k: F.col(k) for k in sums}, pos, neg, w_pos, w_neg)
    arcs = {_hash_of(w): 4.0 for w in INSULTS}
    signed = [s - 2**64 if s >= 2**63 else s for s in arcs]
    seen = F.col("f").isin(signed) & (F.col("p") + F.col("n") >= MIN_SUPPORT)
    # each arc takes MIN_SUPPORT of the sample's toxic texts, so their number is bounded with the sample
    for r in counts.select("f", weight.alias("w"), fits.alias("fits"), seen.alias("seen")).filter("seen or fits").collect():
        if r["fits"]:
            arcs[r["f"] % 2**64] = r["w"]
        else:
            arcs.pop(r["f"] % 2**64, None)
    model = Model.of(prior, arcs)
    if not pos + neg:
        return model

    shared = documents.sparkSession.sparkContext.broadcast(model)

    def patterns(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for row, _, found in _found(shared.value, batch["text"]):
            count.update((k, batch["toxic"][row].as_py()) for *_, k, _ in found)
        yield pa.record_batch([pa.array([k for k, _ in count], pa.string()), pa.array([t for _, t in count], pa.int32()), pa.array(list(count.values()), pa.int64())], ["kind", "toxic", "n"])

    thinned = texts.join(F.broadcast(each.select("id")), "id", "left_semi").select("toxic", "text")
    seen_in: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for r in map_arrow(thinned, patterns, "kind string, toxic int, n long").groupBy("kind", "toxic").agg(F.sum("n").alias("n")).collect():
        seen_in[r["kind"]][r["toxic"]] = r["n"]
    model.offsets, model.rate = offsets_of(seen_in, w_pos, w_neg)
    return model


def offsets_of(seen_in: dict[str, list[int]], w_pos: int, w_neg: int) -> tuple[dict[str, float], float]:
    """The pattern offsets and the rate from the matches of each pattern in clean and toxic texts."""
    scored = {k: v for k, v in seen_in.items() if k in OFFSETS}
    clean, toxic = (sum(v[t] for v in scored.values()) for t in (0, 1))
    usual = math.log((toxic + 1) / (clean + 1))
    out = {}
    for k, start in OFFSETS.items():
        c, t = scored.get(k, (0, 0))
        drawn = (t + c) / (t + c + DRAWN)
        out[k] = max(-MAX_WEIGHT, min(1.0, drawn * (math.log((t + 1) / (c + 1)) - usual) + (1 - drawn) * start))
    return out, SLACK * max(0.0, toxic / (w_pos + 1) - clean / (w_neg + 1))


def score(documents: DataFrame, model: Model) -> DataFrame:
    """doc_id, th (xxhash64 of the text), score and clauses (word range, pattern and weight of each match) of each whole text."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        known: Model = shared.value
        total, clauses = np.full(batch.num_rows, known.prior), [[] for _ in range(batch.num_rows)]
        for row, n, found in _found(known, batch["text"]):
            total[row] = known.weigh([m[2] for m in found], [m[3] for m in found], n)
            clauses[row] = [{"lo": a, "hi": b, "kind": k, "weight": w} for a, b, k, w in found]
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32()), ("kind", pa.string()), ("weight", pa.float64())]))
        value = 1 / (1 + np.exp(-np.clip(total, -500, 500)))
        yield pa.record_batch([batch["doc_id"], batch["th"], pa.array(value), pa.array(clauses, kind)], ["doc_id", "th", "score", "clauses"])

    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("th"))
    return map_arrow(docs, run, "doc_id long, th long, score double, clauses array<struct<lo:int,hi:int,kind:string,weight:double>>")


def toxicity(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score, predicted, clauses."""
    found = score(documents, train(documents, labels, rows))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "clauses")


def drop_toxic(documents: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents that score below THRESHOLD, with their own columns."""
    return without(documents, score(documents, train(documents, labels, rows)).filter(F.col("score") >= THRESHOLD))


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return toxicity(read(spark, sf_dir, "documents"), spark.read.parquet(f"{sf_dir}/labels.parquet")).drop("clauses")
