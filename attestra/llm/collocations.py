"""Phrase collocations from weighted acyclic automata.

Every shard of texts turns its sorted n-grams into a count transducer: a path spells an n-gram and its weight is how often
it occurs. A shard's transducer is cut by prefix ranges of the n-gram order, so that one task unites and sums each range over
all shards. The frequent n-grams, read forwards and backwards, then form transducers again, and candidate phrases are
composed with them: the weights a path passes are the counts of its first parts, or of its last parts when read backwards.
"""

from __future__ import annotations

import struct
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import small_batches, tabled, text_of

PIECE_ENDS = b".,;:!?\n\x0b\x0c\r"
_BREAKS = bytes.maketrans(PIECE_ENDS + b"\t", b"\n" * len(PIECE_ENDS) + b" ")
# Texts of one shard, and the text whose n-grams fall into one prefix range: both bound the memory of a task.
SHARD_BYTES = 16 << 20
RANGE_BYTES = 8 << 20
RANGE_PHRASES = 200_000
# Prefix ranges at most and phrases sampled for each: the driver sorts so many short phrases. Beyond half a terabyte ranges widen.
MOST_RANGES = 1 << 16
RANGE_SAMPLES = 32
SHARES = 32
NO_LANG = "und"


@dataclass
class Transducer:
    """Counts of n-grams of up to three words as a trie in arrays, nodes of a level in n-gram order.

    words are sorted by their bytes and a label is a place there. parent is a place in the level above. A weight of zero
    marks a node that is only on the way to others.
    """
    words: list[bytes]
    labels: list[np.ndarray]
    parents: list[np.ndarray]
    weights: list[np.ndarray]

    def grams(self) -> list[tuple[np.ndarray, ...]]:
        """Per level the columns of words and the weight of all paths."""
        first = self.labels[0]
        one, two = first[self.parents[1]], self.labels[1]
        return [(first, self.weights[0]), (one, two, self.weights[1]),
                (one[self.parents[2]], two[self.parents[2]], self.labels[2], self.weights[2])]


def summed(keys: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and the sum of their weights."""
    order = np.argsort(keys, kind="stable")
    keys, weights = keys[order], weights[order]
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    return keys[starts], np.add.reduceat(weights, starts) if len(keys) else weights


def transducer(words: list[bytes], grams: list[tuple[np.ndarray, ...]]) -> Transducer:
    """The transducer of n-grams given per length as columns of labels and a weight; equal ones are summed."""
    size = max(1, len(words))
    (a1, w1), (a2, b2, w2), (a3, b3, c3, w3) = grams
    none = lambda x: np.zeros(len(x), dtype=np.int64)
    pairs, pair_weights = summed(np.r_[a2 * size + b2, a3 * size + b3], np.r_[w2, none(a3)])
    firsts, first_weights = summed(np.r_[a1, pairs // size], np.r_[w1, none(pairs)])
    under = np.searchsorted(pairs, a3 * size + b3)
    triples, triple_weights = summed(under * size + c3, w3)
    return Transducer(words, [firsts, pairs % size, triples % size],
                      [none(firsts), np.searchsorted(firsts, pairs // size), triples // size],
                      [first_weights, pair_weights, triple_weights])


def labelled(words: pa.Array) -> tuple[list[bytes], np.ndarray]:
    """The distinct words in byte order and the label of every word."""
    coded = words.dictionary_encode()
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    label = np.empty(len(order), dtype=np.int64)
    label[order] = np.arange(len(order))
    return coded.dictionary.take(pa.array(order)).to_pylist(), label[coded.indices.to_numpy()]


def pieces(texts: list[bytes]) -> tuple[list[bytes], np.ndarray]:
    """Words of the texts in byte order, and the texts as labels with -1 where a piece ends. Only A-Z are lower-cased."""
    joined = b"\n".join(texts).lower().translate(_BREAKS).replace(b"\n", b" \n ")
    words = pc.split_pattern(pa.array([joined], pa.large_binary()), pattern=b" ").values
    words, at = labelled(words.filter(pc.not_equal(pc.binary_length(words), 0)))
    end = bisect_left(words, b"\n")
    if end < len(words) and words[end] == b"\n":
        at = np.where(at == end, -1, at - (at > end))
        del words[end]
    return words, at


def shard(texts: list[bytes]) -> Transducer:
    """The count transducer of a few texts."""
    words, at = pieces(texts)
    columns = []
    for n in (1, 2, 3):
        windows = [at[k:max(0, len(at) - n + 1 + k)] for k in range(n)]
        whole = np.logical_and.reduce([w >= 0 for w in windows])
        columns.append((*[w[whole] for w in windows], np.ones(int(whole.sum()), dtype=np.int64)))
    return transducer(words, columns)


def union(parts: list[Transducer]) -> Transducer:
    """One transducer whose weights are the sums over all parts."""
    if len(parts) == 1:
        return parts[0]
    words, labels = labelled(pa.array([w for p in parts for w in p.words], pa.binary()))
    ends = np.cumsum([0] + [len(p.words) for p in parts])
    found = [p.grams() for p in parts]
    grams = []
    for level in range(3):
        named = [[labels[at:][c] for c in g[level][:-1]] + [g[level][-1]] for at, g in zip(ends, found)]
        grams.append(tuple(np.concatenate(c) for c in zip(*named)))
    return transducer(words, grams)


def slices(whole: Transducer, bounds: list[tuple[bytes, ...]]) -> Iterator[tuple[int, Transducer]]:
    """The non-empty parts of a transducer between ascending bounds; part k holds the n-grams from bound k - 1 on."""
    cuts = np.array([[0, 0, 0]] + [_below(whole, b) for b in bounds] + [[len(x) for x in whole.labels]])
    for k, (low, high) in enumerate(zip(cuts[:-1], cuts[1:])):
        if (low == high).all():
            continue
        # the first nodes of a level may be there only as the way to the first node below
        third = slice(low[2], high[2])
        start = min([low[1]] + whole.parents[2][low[2]:high[2]][:1].tolist())
        second = slice(start, high[1])
        top = min([low[0]] + whole.parents[1][start:high[1]][:1].tolist())
        first = slice(top, high[0])
        weights = [whole.weights[0][first].copy(), whole.weights[1][second].copy(), whole.weights[2][third]]
        weights[0][:low[0] - top], weights[1][:low[1] - start] = 0, 0
        labels = [whole.labels[0][first], whole.labels[1][second], whole.labels[2][third]]
        used = np.unique(np.concatenate(labels))
        yield k, Transducer([whole.words[w] for w in used], [np.searchsorted(used, x) for x in labels],
                            [whole.parents[0][first], whole.parents[1][second] - top, whole.parents[2][third] - start], weights)


def _below(whole: Transducer, bound: tuple[bytes, ...]) -> list[int]:
    """How many nodes of each level lie below a bound in n-gram order."""
    counts, low, high = [], 0, len(whole.labels[0])
    for level in range(3):
        label = whole.labels[level]
        if level < len(bound):
            at = bisect_left(whole.words, bound[level])
            known = at < len(whole.words) and whole.words[at] == bound[level]
            low, high = low + np.searchsorted(label[low:high], at), low + np.searchsorted(label[low:high], at + known)
            counts.append(int(high if level + 1 < len(bound) else low))
        else:
            counts.append(int(low))
        if level < 2:
            nodes = whole.parents[level + 1]
            if level + 1 >= len(bound):
                high = low
            low, high = np.searchsorted(nodes, low), np.searchsorted(nodes, high)
    return counts


def _packed(numbers: np.ndarray) -> bytes:
    most = int(numbers.max(initial=0))
    kind = next(t for t in ("<u1", "<u2", "<u4", "<u8") if most <= np.iinfo(t).max)
    return struct.pack("<cq", kind[2:].encode(), len(numbers)) + numbers.astype(kind).tobytes()


def encode(whole: Transducer) -> bytes:
    """Bytes of the minimal automaton: two-word nodes with equal continuations and weights share one state."""
    starts = np.searchsorted(whole.parents[2], np.arange(len(whole.labels[1]) + 1))
    degree = np.diff(starts)
    state = np.zeros(len(degree), dtype=np.int64)  # state 0 is final
    single = np.flatnonzero(degree == 1)
    arcs = np.stack([whole.labels[2][starts[single]], whole.weights[2][starts[single]]], axis=1)
    kept, named = np.unique(arcs, axis=0, return_inverse=True) if len(single) else (arcs, single)
    state[single] = 1 + named.ravel()
    sizes, labels, weights = [np.ones(len(kept), dtype=np.int64)], [kept[:, 0]], [kept[:, 1]]
    register: dict[bytes, int] = {}
    both = np.stack([whole.labels[2], whole.weights[2]], axis=1)
    many = np.flatnonzero(degree > 1)
    for node, a, b in zip(many.tolist(), starts[many].tolist(), starts[many + 1].tolist()):
        found = both[a:b].tobytes()
        number = register.setdefault(found, len(register))
        if number == len(sizes) - 1:
            sizes.append(np.array([b - a]))
            labels.append(both[a:b, 0])
            weights.append(both[a:b, 1])
        state[node] = 1 + len(kept) + number
    counts = np.bincount(whole.parents[1], minlength=len(whole.labels[0]))
    arrays = [whole.labels[0], whole.weights[0], counts, whole.labels[1], whole.weights[1], state,
              np.concatenate(sizes), np.concatenate(labels), np.concatenate(weights)]
    words = b" ".join(whole.words)
    return struct.pack("<q", len(words)) + words + b"".join(map(_packed, arrays))


def decode(data: bytes) -> Transducer:
    """The transducer whose minimal automaton was encoded."""
    at = 8 + struct.unpack_from("<q", data)[0]
    words, arrays = data[8:at].split(b" ") if at > 8 else [], []
    while at < len(data):
        kind, n = struct.unpack_from("<cq", data, at)
        at += 9
        arrays.append(np.frombuffer(data, f"<u{kind.decode()}", n, at).astype(np.int64))
        at += n * int(kind)
    first, w1, counts, second, w2, state, sizes, labels, weights = arrays
    sizes = np.r_[0, sizes]
    starts, degree = (np.cumsum(sizes) - sizes)[state], sizes[state]
    parents = np.repeat(np.arange(len(second)), degree)
    arc = np.arange(len(parents)) - np.repeat(np.cumsum(degree) - degree, degree) + np.repeat(starts, degree)
    return Transducer(words, [first, second, labels[arc]], [np.zeros(len(first), dtype=np.int64), np.repeat(np.arange(len(first)), counts), parents],
                      [w1, w2, weights[arc]])


def _sampled(docs: DataFrame, every: int) -> list[tuple[str, tuple[bytes, ...]]]:
    """Sorted (lang, n-gram) pairs of up to three words from every so many words of a 64th of the texts; they only balance ranges."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, grams = [], []
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                words, at = pieces([text])
                for place in range(len(text) % every, len(at), every):
                    run = at[place:place + 3].tolist()
                    run = run[:run.index(-1)] if -1 in run else run
                    if run:
                        langs.append(lang)
                        grams.append([words[w] for w in run])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(grams, pa.list_(pa.binary()))], ["lang", "gram"])

    some = docs.where(F.pmod(F.xxhash64("text", F.lit("sample")), F.lit(64)) == 0)
    return sorted((r["lang"], tuple(map(bytes, r["gram"]))) for r in some.mapInArrow(pick, "lang string, gram array<binary>").collect())


def _bounds(sample: list, ranges: int) -> list:
    """Ascending distinct sample members that cut the order into ranges of about equal size."""
    places = [len(sample) * k // ranges for k in range(1, ranges)] if sample else []
    return sorted({sample[p] for p in places})


def counted(docs: DataFrame, least: int) -> DataFrame:
    """Columns lang, phrase, size and f of all n-grams that occur at least `least` times, and per lang a row of size 0
    whose f is the number of words. docs has the columns lang and text (binary), no nulls.
    """
    small_batches(docs.sparkSession)
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = min(MOST_RANGES, -(-total // RANGE_BYTES)) or 1
    every = max(1, total // (64 * 6 * RANGE_SAMPLES * ranges))  # words have some six bytes
    bounds = _bounds(_sampled(docs, every), ranges) if ranges > 1 else []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[str, list[bytes]] = {}
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, texts in waiting.items():
                # bounds of this lang, after those of lower ones
                start, end = bisect_left(bounds, (lang,)), bisect_left(bounds, (lang + "\0",))
                for k, part in slices(shard(texts), [b[1] for b in bounds[start:end]]):
                    yield pa.RecordBatch.from_arrays([pa.array([start + k], pa.int32()), pa.array([lang], pa.string()), pa.array([encode(part)], pa.binary())],
                                                     ["part", "lang", "automaton"])
            waiting.clear()

        for batch in batches:
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist()):
                waiting.setdefault(lang, []).append(text)
                size += len(text)
                if size >= SHARD_BYTES:
                    yield from flush()
                    size = 0
        yield from flush()

    def unite(group: pd.DataFrame) -> pd.DataFrame:
        whole = union([decode(a) for a in group["automaton"]])
        lang, words = group["lang"].iloc[0], whole.words
        phrases, sizes, counts = [None], [0], [int(whole.weights[0].sum())]
        for n, (*columns, weight) in enumerate(whole.grams(), 1):
            often = np.flatnonzero(weight >= least)
            phrases += [b" ".join([words[w] for w in gram]).decode("utf-8", "replace") for gram in zip(*[c[often].tolist() for c in columns])]
            sizes += [n] * len(often)
            counts += weight[often].tolist()
        return pd.DataFrame({"lang": lang, "phrase": phrases, "size": sizes, "f": counts})

    parts = docs.mapInArrow(build, "part int, lang string, automaton binary")
    return parts.groupBy("part", "lang").applyInPandas(unite, "lang string, phrase string, size int, f long")


def composed(grams: DataFrame, backwards: bool) -> DataFrame:
    """Columns lang, phrase, f, part_1, part_2 and longer: of every n-gram its count, those of its first one and two words
    (read backwards: its last ones), and the largest count of an n-gram with one more word at the other end.

    A row without f only tells of longer ones. Two rows per phrase and range at most: where the longer ones of a phrase
    lie in several ranges, the phrase is sent to each of them.
    """
    key = F.split("phrase", " ")
    keyed = grams.where("size > 0").select("lang", (F.reverse(key) if backwards else key).alias("gram"), "f")
    n = keyed.count()
    ranges = min(MOST_RANGES, -(-n // RANGE_PHRASES)) or 1
    chance = min(1.0, ranges * RANGE_SAMPLES * 4 / max(1, n))
    draw = F.pmod(F.xxhash64("gram", F.lit(backwards)), F.lit(1 << 20)) < F.lit(int(chance * (1 << 20)) + 1)
    sample = sorted((r["lang"], tuple(w.encode() for w in r["gram"])) for r in keyed.where(draw).select("lang", "gram").collect()) if ranges > 1 else []
    bounds = _bounds(sample, ranges)

    def place(lang: str, gram: list[str]) -> list[int]:
        own = (lang, tuple(w.encode() for w in gram))
        home = bisect_right(bounds, own)
        last = home
        while last < len(bounds) and bounds[last][0] == lang and bounds[last][1][:len(gram)] == own[1]:
            last += 1
        return list(range(home, last + 1))

    @F.pandas_udf("array<int>")
    def places(langs: pd.Series, found: pd.Series) -> pd.Series:
        return pd.Series([place(lang, list(gram)) for lang, gram in zip(langs, found)])

    def compose(group: pd.DataFrame) -> pd.DataFrame:
        lang = group["lang"].iloc[0]
        rows = [[w.encode() for w in gram] for gram in group["gram"]]
        words, labels = labelled(pa.array([w for r in rows for w in r], pa.binary()))
        sizes = np.array([len(r) for r in rows])
        starts, f = np.cumsum(sizes) - sizes, group["f"].to_numpy()
        grams = [(*[labels[starts[sizes == n] + k] for k in range(n)], f[sizes == n]) for n in (1, 2, 3)]
        whole = transducer(words, grams)
        one = whole.weights[0][whole.parents[1]]
        longer = np.zeros(len(one), dtype=np.int64)
        np.maximum.at(longer, whole.parents[2], whole.weights[2])
        pairs = pd.DataFrame({"w": list(zip(*[c.tolist() for c in whole.grams()[1][:2]])), "f": whole.weights[1], "part_1": one, "part_2": 0, "longer": longer})
        triples = pd.DataFrame({"w": list(zip(*[c.tolist() for c in whole.grams()[2][:3]])), "f": whole.weights[2], "part_1": one[whole.parents[2]],
                                "part_2": whole.weights[1][whole.parents[2]], "longer": 0})
        out = pd.concat([pairs, triples], ignore_index=True)
        step = -1 if backwards else 1
        out.insert(0, "phrase", pd.Series([b" ".join([words[w] for w in gram][::step]).decode() for gram in out.pop("w")], out.index, dtype=object))
        out.insert(0, "lang", lang)
        return out

    sent = keyed.withColumn("part", F.explode(places("lang", "gram"))) if bounds else keyed.withColumn("part", F.lit(0))
    return sent.groupBy("part", "lang").applyInPandas(compose, "lang string, phrase string, f long, part_1 long, part_2 long, longer long")


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, covered: int = 50, first: int | None = 2000) -> DataFrame:
    """Columns lang, rank, phrase, a, l, r, n and score: phrases of two and three words, best first in every lang.

    a, l and r count the phrase and the two parts of the cut that scores lowest; n counts the words of the lang; score is
    floor(1000000 * a * a / (l * r)). Phrases with fewer than `least` occurrences are no candidates; one that lies in a longer
    candidate with `covered` per cent of its occurrences or more is dropped. `first` (None: all) is the length of a lang's report.
    Null texts are empty, a null lang is `und`; repeated rows count each; ties go to the larger a, then to the smaller phrase in byte order.
    Other columns are dropped. An empty table, or one without candidates, gives an empty result.
    """
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(NO_LANG)).alias("lang"), text_of(text).cast("binary").alias("text"))
    grams = tabled(counted(rows, least))
    ahead = composed(grams, False).selectExpr("lang", "phrase", "f", "part_1 l1", "part_2 l2", "longer", "0L r1", "0L r2")
    back = composed(grams, True).selectExpr("lang", "phrase", "f", "0L l1", "0L l2", "longer", "part_1 r1", "part_2 r2")
    both = ahead.unionByName(back).groupBy("lang", "phrase").agg(*[F.max(c).alias(c) for c in ("f", "l1", "l2", "r1", "r2", "longer")])
    left = both.where(100 * F.col("longer").cast("decimal(20,0)") < covered * F.col("f").cast("decimal(20,0)")).withColumnRenamed("f", "a")
    # cut after one word: the rest is the last word of two, the last two of three
    cut = lambda l, r: f"named_struct('score', 1000000 * cast(a as decimal(15,0)) * cast(a as decimal(15,0)) div (cast({l} as decimal(19,0)) * cast({r} as decimal(19,0))), 'l', {l}, 'r', {r})"
    scored = left.withColumns({"one": F.expr(cut("l1", "if(r2 > 0, r2, r1)")), "two": F.expr(f"if(l2 > 0, {cut('l2', 'r1')}, null)")})
    best = F.when(F.col("two.score") < F.col("one.score"), F.col("two")).otherwise(F.col("one"))
    scored = scored.withColumn("best", best).select("lang", "phrase", "a", "best.l", "best.r", "best.score")
    best_first = F.desc("score"), F.desc("a"), F.asc("phrase")
    if first is not None:  # the first ones of every share of a lang, so its last task ranks no more than these
        share = F.pmod(F.xxhash64("phrase"), F.lit(SHARES))
        scored = scored.withColumn("place", F.row_number().over(Window.partitionBy("lang", share).orderBy(*best_first))).where(F.col("place") <= first)
    order = Window.partitionBy("lang").orderBy(*best_first)
    ranked = scored.withColumn("rank", F.row_number().over(order).cast("long"))
    if first is not None:
        ranked = ranked.where(F.col("rank") <= first)
    totals = grams.where("size = 0").groupBy("lang").agg(F.sum("f").alias("n"))
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
