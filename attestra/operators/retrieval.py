"""TF-IDF retrieval, diverse context and profile matching."""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import find_all, sub
from ..functions.text import key
from ..session import dropped_shuffles, shared_folder
from .permits import containing_pairs

# Weights of the two parts of the fused score.
WORD_WEIGHT, CHAR_WEIGHT = 0.65, 0.35
# Text of one block of documents and of the documents whose terms one range counts, questions that meet a block at once, and the columns of a dense piece of weights.
BLOCK_BYTES, RANGE_BYTES, QUESTIONS, TILE = 2 << 20, 8 << 20, 1024, 1024
WORD = r"[\w\[\]/.%'*-]+"
# Letters of the pieces of a word.
PIECES = (2, 3, 4, 5)


def _split(texts: DataFrame, keys: list[str], words: bool, chars: bool) -> DataFrame:
    """Columns keys, w (words, case kept) and c (words between white space), an array each, empty if the part is not used."""
    none = F.array().cast("array<string>")
    cut = F.filter(F.split(sub(F.col("text"), r"\s+", " "), " "), lambda w: w != "")
    return texts.where("text is not null").select(*keys, (find_all(F.col("text"), WORD) if words else none).alias("w"), (cut if chars else none).alias("c"))


def _hashes(terms: list[str]) -> np.ndarray:
    return pd.util.hash_array(np.array(terms, dtype=object), categorize=False) if terms else np.zeros(0, np.uint64)


def _numbered(code: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes ascending with their summed numbers."""
    if len(code) and int(code.max()) < 1 << 42 and int(n.max()) < 1 << 20:  # both fit in one long, which sorts faster than an order
        both = np.sort(code << 20 | n)
        code, n = both >> 20, both & (1 << 20) - 1
    else:
        order = np.argsort(code, kind="stable")
        code, n = code[order], n[order]
    first = np.flatnonzero(np.r_[True, code[1:] != code[:-1]][:len(code)])
    return code[first], np.add.reduceat(n, first) if len(first) else n


def _pairs(words: list[str], ids: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places whose word and the next one are a pair of a text, and a code of each: word number times the number of words plus word number."""
    at = np.flatnonzero(text[1:] == text[:-1])
    return at, ids[at] * len(words) + ids[at + 1]


def _pieces(words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Distinct pieces of 2 to 5 letters inside words padded with a blank on both sides; the pieces of all words one after the other, and how many each has."""
    padded = "".join(f" {w} " for w in words)
    length = np.array([len(w) + 2 for w in words], dtype=np.int64)
    letters, one = np.unique(np.frombuffer(padded.encode("utf-32-le", "surrogatepass"), dtype="<u4"), return_inverse=True)
    owner, end = np.repeat(np.arange(len(words)), length), np.repeat(np.cumsum(length), length)
    place, number = np.arange(len(one)), one.astype(np.int64)
    terms, owners, found = [], [], []
    for size in PIECES:  # a piece is the number of the piece one letter shorter and a letter, so codes stay small whatever the alphabet
        at = np.flatnonzero(place + size <= end)
        distinct, which = np.unique(number[at] * len(letters) + one[at + size - 1], return_inverse=True)
        first = np.empty(len(distinct), np.int64)
        first[which] = at  # any place of a piece spells it
        number = number.copy()
        number[at] = which
        owners.append(owner[at])
        found.append(which + len(terms))
        terms += [padded[i:i + size] for i in first.tolist()]
    owners = np.concatenate(owners)
    return terms, np.concatenate(found)[np.argsort(owners)], np.bincount(owners, minlength=len(words))


@dataclass(frozen=True)
class Terms:
    """Terms of some texts: keys ascending, distinct terms, the hash of each, and by key number and term number how often a term occurs.

    The terms of equal sets of texts have the same order whatever the order of the texts. Words go before pairs.
    """
    keys: np.ndarray
    words: list[str]
    pairs: np.ndarray
    pieces: list[str]
    hashes: np.ndarray
    row: np.ndarray
    item: np.ndarray
    n: np.ndarray

    def terms(self) -> list[str]:
        if self.pieces:
            return self.pieces
        first, second = np.divmod(self.pairs, max(len(self.words), 1))
        return self.words + [f"{self.words[a]} {self.words[b]}" for a, b in zip(first.tolist(), second.tolist())]

    def ranges(self, ranges: int) -> list[np.ndarray]:
        """Numbers of the terms of each range, ascending."""
        of = (self.hashes >> np.uint64(11)) % np.uint64(ranges)
        order = np.argsort(of, kind="stable")
        return np.split(order, np.searchsorted(of[order], np.arange(1, ranges, dtype=np.uint64)))

    def places(self, wanted: list[str]) -> np.ndarray:
        """The number of each wanted term, -1 where the texts lack it."""
        if self.pieces or not self.words:
            return pc.fill_null(pc.index_in(pa.array(wanted, pa.string()), pa.array(self.pieces, pa.string())), -1).to_numpy().astype(np.int64)
        parts = [w.split(" ") for w in wanted]
        known = pa.array(self.words, pa.string())
        first, last = (pc.fill_null(pc.index_in(pa.array([p[k] for p in parts], pa.string()), known), -1).to_numpy().astype(np.int64) for k in (0, -1))
        code = first * len(self.words) + last
        at = np.minimum(np.searchsorted(self.pairs, code), max(len(self.pairs) - 1, 0))
        met = (first >= 0) & (last >= 0) & (self.pairs[at] == code) if len(self.pairs) else np.zeros(len(parts), bool)
        return np.where(np.array([len(p) == 1 for p in parts], bool), first, np.where(met, at + len(self.words), -1))


def _counts(texts: pa.Table, key: str, column: str) -> Terms:
    lists = texts[column].combine_chunks()
    keys, number = np.unique(texts[key].to_numpy(), return_inverse=True)
    text = pc.list_parent_indices(lists).to_numpy()
    encoded = pc.list_flatten(lists).dictionary_encode()
    order = pc.sort_indices(encoded.dictionary)
    words, rank = encoded.dictionary.take(order).cast(pa.string()).to_pylist(), np.empty(len(order), np.int64)
    rank[order.to_numpy()] = np.arange(len(order))
    ids, row = rank[encoded.indices.to_numpy()], number[text].astype(np.int64)
    if column == "w":
        at, code = _pairs(words, ids, text)
        pairs, which = np.unique(code, return_inverse=True)
        total = max(len(words) + len(pairs), 1)
        posted, n = np.unique(np.concatenate([row * total + ids, row[at] * total + len(words) + which]), return_counts=True)
        row, item = np.divmod(posted, total)
        of = _hashes(words)
        first, second = np.divmod(pairs, max(len(words), 1))
        mixed = of[first] * np.uint64(0x9E3779B97F4A7C15) + of[second]
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
        return Terms(keys, words, pairs, [], np.concatenate([of, mixed]), row, item, n)
    posted, n = np.unique(row * max(len(words), 1) + ids, return_counts=True)
    row, word = np.divmod(posted, max(len(words), 1))
    none = np.zeros(0, np.int64)
    if not words:
        return Terms(keys, [], none, [], np.zeros(0, np.uint64), none, none, none)
    terms, flat, many = _pieces(words)  # equal words of a text are cut once
    start, many = (np.cumsum(many) - many)[word], many[word]
    inside = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
    code, n = _numbered(np.repeat(row, many) * len(terms) + flat[np.repeat(start, many) + inside], np.repeat(n, many))
    row, item = np.divmod(code, len(terms))
    return Terms(keys, [], none, terms, _hashes(terms), row, item, n)


def _packed(data: bytes) -> bytes:
    return pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: pa.Scalar, size: int) -> bytes:
    return pa.decompress(data.as_buffer(), decompressed_size=size, codec="zstd", asbytes=True)


CELLS = "block long, range long, part string, n long, terms binary, size long, df binary"


def _frequencies(ranges: int):
    """Terms of a block by range, in one compressed text, and how many of its documents have each."""
    def count(key: tuple, texts: pa.Table) -> pa.Table:
        out = []
        for part in ("w", "c"):
            found = _counts(texts, "doc", part)
            df = np.bincount(found.item, minlength=len(found.hashes)).astype("<u4")
            terms = found.terms()
            for k, of in enumerate(found.ranges(ranges)):
                if len(of):
                    raw = "\n".join([terms[i] for i in of.tolist()]).encode()
                    out.append((key[0].as_py(), k, part, len(of), _packed(raw), len(raw), _packed(df[of].tobytes())))
        names = ["block", "range", "part", "n", "terms", "size", "df"]
        types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.binary()]
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * len(names), types)], names=names)
    return count


def _merged(cells: pa.Table, wanted: pa.Table) -> pa.Table:
    """Of one range: how many documents of all blocks have each term, in the order of the terms of every block, and the same of the asked terms."""
    out, asked = [], []
    for part in ("w", "c"):
        mine = cells.filter(pc.equal(cells["part"], part)).combine_chunks()
        if not mine.num_rows:
            continue
        texts = [_unpacked(t, size).decode().split("\n") for t, size in zip(mine["terms"], mine["size"].to_pylist())]
        encoded = pa.array(list(chain.from_iterable(texts)), pa.large_string()).dictionary_encode()
        number = encoded.indices.to_numpy()
        sizes = mine["n"].to_pylist()
        df = np.concatenate([np.frombuffer(_unpacked(d, 4 * n), dtype="<u4") for d, n in zip(mine["df"], sizes)])
        total = np.bincount(number, df).astype("<u4")
        for block, n, of in zip(mine["block"].to_pylist(), sizes, np.split(total[number], np.cumsum(sizes)[:-1])):
            out.append((block, part, n, _packed(of.tobytes()), None, None))
        terms = wanted.filter(pc.equal(wanted["part"], part))["term"].to_pylist()
        for term, place in zip(terms, pc.index_in(pa.array(terms, pa.large_string()), encoded.dictionary).to_pylist()):
            if place is not None:
                asked.append((None, part, None, None, term, int(total[place])))
    range_ = cells["range"][0].as_py() if cells.num_rows else None
    types = [pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64()]
    columns = [pa.array(c, t) for c, t in zip(zip(*out, *asked) if out or asked else [[]] * len(types), types)]
    return pa.table([pa.array([range_] * len(columns[0]), pa.int64()), *columns], names=["range", "block", "part", "n", "df", "term", "total"])


def _occurrences(ranges: int):
    """Terms of each question with their counts and ranges."""
    def count(key: tuple, texts: pa.Table) -> pa.Table:
        out = []
        for part in ("w", "c"):
            found = _counts(texts, "query", part)
            terms, of = pa.array(found.terms(), pa.string()), np.zeros(len(found.hashes), np.int64)
            for k, some in enumerate(found.ranges(ranges)):
                of[some] = k
            out.append(pa.table({"query": pa.array(found.keys[found.row], texts.schema.field("query").type), "part": pa.array([part] * len(found.row), pa.string()),
                                 "term": terms.take(pa.array(found.item)), "range": of[found.item], "tf": found.n.astype(np.int64)}))
        return pa.concat_tables(out)
    return count


ASKED = "share bigint, part string, query array<{query}>, scale array<double>, n long, size long, terms binary, asking binary, tf binary, starts binary"


def _questions(key: tuple, rows: pa.Table) -> pa.Table:
    """The terms of the questions of one share and part in one compressed text, and of each term the questions that have it and how often.

    A weight is the count times the idf, which a block knows of its terms, times the scale of the question.
    """
    queries, number = np.unique(rows["query"].to_numpy(), return_inverse=True)
    encoded = rows["term"].combine_chunks().dictionary_encode()
    term = encoded.indices.to_numpy()
    order = np.lexsort((number, term))
    scale = np.zeros(len(queries))
    scale[number] = rows["scale"].to_numpy()
    terms = encoded.dictionary.to_pylist()
    raw = "\n".join(terms).encode()
    starts = np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(terms)))])
    packed = [pa.array([_packed(raw)], pa.binary()), *[pa.array([_packed(x.astype("<i8").tobytes())], pa.binary()) for x in (number[order], rows["tf"].to_numpy()[order], starts)]]
    return pa.table([pa.array([key[0].as_py()], pa.int64()), pa.array([key[1].as_py()], pa.string()), pa.array([queries], pa.list_(rows.schema.field("query").type)),
                     pa.array([scale], pa.list_(pa.float64())), pa.array([len(order)], pa.int64()), pa.array([len(raw)], pa.int64()), *packed],
                    names=["share", "part", "query", "scale", "n", "size", "terms", "asking", "tf", "starts"])


def rank_scores(scores: DataFrame, k: int) -> DataFrame:
    """Positive scores ranked per query; equal scores keep document order."""
    order = Window.partitionBy("query").orderBy(F.desc(F.round("score", 9)), "doc")
    return scores.where(F.col("score") > 0).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block_scores(k: int, documents: int, ranges: int):
    """Best documents of one block for the questions of one share: the cosine of weighted terms, summed over the parts."""
    def score(texts: pa.Table, weights: pa.Table) -> pa.Table:
        kept_in = weights.schema.field("query").type.value_type
        none = pa.table({"query": pa.array([], kept_in), "doc": pa.array([], texts.schema.field("doc").type), "score": pa.array([], pa.float64())})
        asked = weights.filter(pc.is_valid(weights["terms"])).combine_chunks()
        if not texts.num_rows or not asked.num_rows:
            return none
        queries = np.unique(pc.list_flatten(asked["query"]).to_numpy())
        docs = np.unique(texts["doc"].to_numpy())
        scores = np.zeros((len(docs), len(queries)))
        for part in ("w", "c"):
            found = _counts(texts, "doc", part)
            mine = asked.filter(pc.equal(asked["part"], part)).combine_chunks()
            if not len(found.hashes) or not mine.num_rows:
                continue
            df = np.zeros(len(found.hashes))
            of = found.ranges(ranges)
            cells = weights.filter(pc.and_(pc.is_valid(weights["df"]), pc.equal(weights["part"], part))).combine_chunks()
            for at, n, packed in zip(cells["range"].to_pylist(), cells["n"].to_pylist(), cells["df"]):
                df[of[at]] = np.frombuffer(_unpacked(packed, 4 * n), dtype="<u4")
            idf = np.log((1.0 + documents) / (df + 1)) + 1
            weight = found.n * idf[found.item]
            weight /= np.sqrt(np.bincount(found.row, weight * weight, len(docs)))[found.row]
            # columns of the dense pieces: the asked terms of this block
            n, size = mine["n"][0].as_py(), mine["size"][0].as_py()
            place = found.places(_unpacked(mine["terms"][0], size).decode().split("\n"))
            starts = np.frombuffer(_unpacked(mine["starts"][0], 8 * (len(place) + 1)), dtype="<i8")
            asking, tf = (np.frombuffer(_unpacked(mine[c][0], 8 * n), dtype="<i8") for c in ("asking", "tf"))
            place = np.repeat(place, np.diff(starts))
            asking, tf, place = asking[place >= 0], tf[place >= 0], place[place >= 0]
            known = np.unique(place)
            column = np.full(len(df), -1)
            column[known] = np.arange(len(known))
            at, term = column[place], column[found.item]
            row, weight, term = found.row[term >= 0], weight[term >= 0], term[term >= 0]
            order = np.argsort(term)
            row, weight, term = row[order], weight[order], term[order]
            query = np.searchsorted(queries, mine["query"][0].values.to_numpy())[asking]
            value = tf * idf[place] * mine["scale"][0].values.to_numpy()[asking]
            for start in range(0, len(known), TILE):
                here, there = slice(*np.searchsorted(term, [start, start + TILE])), (at >= start) & (at < start + TILE)
                left, right = np.zeros((len(docs), TILE)), np.zeros((TILE, len(queries)))
                left[row[here], term[here] - start] = weight[here]
                right[at[there] - start, query[there]] = value[there]
                scores += left @ right
        # documents ascend, so a stable sort keeps their order among equal scores
        best = np.argsort(-np.round(scores, 9), axis=0, kind="stable")[:k]
        at = np.broadcast_to(np.arange(len(queries)), best.shape)
        value = scores[best, at].ravel()
        kept = value > 0
        return pa.table({"query": pa.array(queries[at.ravel()[kept]], kept_in), "doc": pa.array(docs[best.ravel()[kept]], texts.schema.field("doc").type), "score": value[kept]})
    return score


def search(corpus: DataFrame, questions: DataFrame, k: int, words: bool = True, chars: bool = True, common_share: float = 0.1,
           block_bytes: int = BLOCK_BYTES, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Top documents per question, exact, by the cosine of tf * idf with idf = ln((1+n)/(1+df)) + 1. corpus: doc, text; questions: query, text.

    Terms are words and pairs of neighbouring words, and pieces of words. Documents are dealt to blocks of about `block_bytes` of
    text. Postings are never stored or shuffled: a block counts them twice from its texts, first for the document frequencies, then
    for the weights. The distinct terms of a block travel once, compressed, to one range of terms for every `range_bytes` of text,
    and only their frequencies come back, in the order of the terms. Every block meets every share of questions and leaves its best
    k of each. Texts of equal doc are one document, texts of equal query one question.
    `common_share` has no effect: frequent terms are scored like all others.
    """
    spark = corpus.sparkSession
    # a document counts for a little text at least, so that blocks of short texts stay small too
    documents, size = corpus.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 1024), F.lit(0))).first()
    cores = spark.sparkContext.defaultParallelism
    blocks = int(max(4 * cores, -(-size // block_bytes)))
    ranges = int(max(cores, -(-size // range_bytes)))
    shares = max(1, -(-questions.count() // QUESTIONS))
    # no fewer parts than a shuffle has, so that texts travel once and are cut where their block is
    parts = max(blocks, int(spark.conf.get("spark.sql.shuffle.partitions")))
    dealt = corpus.select(F.pmod(F.xxhash64("doc"), F.lit(blocks)).alias("block"), "doc", "text")
    path = f"{shared_folder(spark)}/search-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        # files tell the optimizer their size, so that few questions are broadcast and many are not
        with dropped_shuffles(spark):
            df.write.parquet(f"{path}/{name}")
        return spark.read.parquet(f"{path}/{name}")

    share = F.pmod(F.xxhash64("query"), F.lit(shares)).alias("share")
    query = questions.schema["query"].dataType.simpleString()
    tf = _split(questions.select(share, "query", "text"), ["share", "query"], words, chars).groupBy("share").applyInArrow(
        _occurrences(ranges), f"query {query}, part string, term string, range long, tf long")
    tf = stored(tf, "questions")
    cells = _split(dealt.repartition(parts, "block"), ["block", "doc"], words, chars).groupBy("block").applyInArrow(_frequencies(ranges), CELLS)
    wanted = tf.select("range", "part", "term").distinct()
    counted = stored(cells.groupBy("range").cogroup(wanted.groupBy("range")).applyInArrow(
        _merged, "range long, block long, part string, n long, df binary, term string, total long"), "df")
    known = counted.where("term is not null").select("part", "term", (F.log((F.lit(1.0) + documents) / (F.col("total") + 1)) + 1).alias("idf"))
    raw = tf.join(known, ["part", "term"]).select("query", "part", "term", "tf", (F.col("tf") * F.col("idf")).alias("w"))
    norms = raw.groupBy("query", "part").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    of_part = F.when(F.col("part") == "w", WORD_WEIGHT if chars else 1.0).otherwise(CHAR_WEIGHT if words else 1.0)
    asked = stored(raw.join(norms, ["query", "part"]).select(share, "part", "query", "term", "tf", (of_part / F.col("norm")).alias("scale")).groupBy(
        "share", "part").applyInArrow(_questions, ASKED.format(query=query)), "asked")

    every = F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(shares - 1).cast("bigint"))).alias("share")
    of_block = counted.where("block is not null").select("block", "range", "part", "n", "df", every)
    weights = of_block.unionByName(spark.range(blocks).withColumnRenamed("id", "block").crossJoin(asked), allowMissingColumns=True)
    texts = _split(dealt.select("*", every).repartition(parts, "block", "share"), ["block", "share", "doc"], words, chars)
    pairs = texts.groupBy("block", "share").cogroup(weights.groupBy("block", "share")).applyInArrow(
        _block_scores(k, documents, ranges), f"query {query}, doc {corpus.schema['doc'].dataType.simpleString()}, score double")
    return rank_scores(pairs, k)


def diverse(ranked: DataFrame, k: int, heads: int = 4) -> DataFrame:
    """The best hit of each domain first (at most `heads`), then the remaining hits in rank order until k.

    ranked: query, doc, domain, rank (bounded per query by the search).
    """
    first = F.row_number().over(Window.partitionBy("query", "domain").orderBy("rank")) == 1
    marked = ranked.withColumn("first", first)
    lead = F.row_number().over(Window.partitionBy("query", "first").orderBy("rank"))
    marked = marked.withColumn("head", F.col("first") & (lead <= heads))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("head"), "rank"))
    return marked.withColumn("place", place).where(F.col("place") <= k).select("query", "doc", "domain", "place")


def best_profiles(questions: DataFrame, aliases: DataFrame) -> DataFrame:
    """Best profile per question and scope: exact alias, alias inside the question, question inside the alias.

    questions: query, text; aliases: scope, profile, alias, priority.
    """
    q = questions.select("query", key(F.col("text")).alias("q_key")).where("q_key <> ''")
    a = aliases.select("scope", "profile", "priority", key(F.col("alias")).alias("a_key")).where("a_key <> ''")
    one = F.lit(0).alias("g")
    pairs = containing_pairs(q.select(one, "q_key"), a.select(one, "a_key"), "g", "q_key", "a_key")
    n, m = F.length("a_key"), F.length("q_key")
    points = (F.when(F.col("q_key") == F.col("a_key"), F.lit(100000) + n).when((n >= 2) & F.col("q_key").contains(F.col("a_key")), F.lit(50000) + n)
              .when((m >= 3) & F.col("a_key").contains(F.col("q_key")), F.lit(10000) + m))
    scored = pairs.withColumn("points", points).where("points is not null").join(a, "a_key")
    best = scored.groupBy("q_key", "scope").agg(F.max(F.struct((F.col("points") + F.col("priority")).alias("score"), "priority", "profile")).alias("b"))
    return q.join(best, "q_key").select("query", "scope", "b.profile", "b.score")


def context_text(selected: DataFrame, budget: int) -> DataFrame:
    """Passages of a question in order, joined until the character budget is spent; the last one is shortened for display.

    selected: query, place, text (a handful of passages per question).
    """
    order = Window.partitionBy("query").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    used = F.coalesce(F.sum(F.length("text") + 2).over(order), F.lit(0))
    kept = selected.withColumn("room", F.lit(budget) - used).where("room > 0").withColumn("piece", F.substr("text", F.lit(1), F.col("room").cast("int")))
    pieces = F.array_sort(F.collect_list(F.struct("place", "piece")))
    return kept.groupBy("query").agg(F.array_join(F.transform(pieces, lambda p: p["piece"]), "\n\n").alias("context"))
