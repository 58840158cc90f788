"""Spelling variants through pairs of trie nodes.

The words form a trie, read forwards, and another, read backwards; the nodes of both are numbered. A word with a code point
skipped at place i is then the integer pair (node of what comes before, node of what follows), and a word cut at place i is such
a pair without a skip. Two words that share a skipped pair differ in that one place; a skipped pair that equals another
word's cut pair is a word with one code point more. So an equality join of integers gives the exact neighbours, however long words are.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import carried, small_batches, stored, tabled, text_of

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 7
# Distinct words that a task counts before it hands them on, and words of one sorted partition.
COUNTED_WORDS = 1 << 19
SORTED_WORDS = 1 << 17
# A form has ten times the count of its word, so no chain of forms is longer than the 18 tenfold steps of a long.
LEAD = 10
DOUBLINGS = 5
_UPPER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
_NODE_BITS = 40
_TAIL = 1 << (_NODE_BITS - 1)


def deleted(word: str, key: str, every: int) -> str:
    """The word without one code point where a checksum of key and word is divisible by `every`."""
    mark = zlib.crc32(f"{key}:{word}".encode())
    if mark % every:
        return word
    at = mark % len(word)
    return word[:at] + word[at + 1:]


def counts(docs: DataFrame, key: str, text: str, every: int) -> DataFrame:
    """Columns word and n: occurrences in all texts of the words of sufficient length that occur twice or more."""
    small_batches(docs.sparkSession)
    runs = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for batch in batches:
            for name, whole in zip(batch["name"], batch["text"]):
                for run, n in Counter(runs.findall(whole)).items():
                    found[deleted(run if run.islower() else run.translate(_UPPER), name, every)] += n
                if len(found) >= COUNTED_WORDS:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found.clear()
        yield pd.DataFrame({"word": list(found), "n": list(found.values())}).astype({"word": object, "n": "int64"})

    rows = docs.select(F.coalesce(carried(key), F.lit("")).alias("name"), text_of(text).alias("text"))
    return (rows.mapInPandas(count, "word string, n long").where(F.length("word") >= LEAST_LENGTH)
            .groupBy("word").agg(F.sum("n").alias("n")).where("n >= 2"))


def common_prefix(a: str, b: str) -> int:
    """How many leading code points two words share."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return next(k for k in range(n) if a[k] != b[k])


def inherited(ends: list[tuple[int, str, str]]) -> dict[int, list[int]]:
    """Per sorted partition (number, first and last word) the nodes that its first word shares with the one before."""
    out: dict[int, list[int]] = {}
    for (before, first, last), (part, start, _) in zip(ends, ends[1:]):
        shared = common_prefix(last, start)
        kept = min(shared, len(out.get(before, [])), common_prefix(first, last))
        out[part] = out.get(before, [])[:kept] + [(before + 1 << _NODE_BITS) | _TAIL | d for d in range(kept + 1, shared + 1)]
    return out


def trie_nodes(words: DataFrame, backwards: bool) -> DataFrame:
    """Columns word, number and nodes: the node of every prefix from the empty one on (backwards: of every suffix).

    Words are sorted in ranges, one range a task, so the nodes of a prefix come one after the other. A prefix that goes on
    in the next range keeps its number: the driver compares the first and last word of every range, no others. Numbers of the
    words ascend in their order.
    """
    key = F.reverse("word") if backwards else F.col("word")
    parts = max(1, -(-words.count() // SORTED_WORDS))
    ordered = words.select("word", key.alias("key")).repartitionByRange(parts, "key").sortWithinPartitions("key")
    ordered = stored(ordered.withColumn("part", F.spark_partition_id()))
    ends = sorted(tuple(r) for r in ordered.groupBy("part").agg(F.min("key"), F.max("key")).collect())
    start, last = inherited(ends), {part: word for part, _, word in ends}

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        before, path, fresh, row = None, [0], 0, 0
        for batch in batches:
            out = []
            for word, part in zip(batch["key"], batch["part"]):
                if before is None:
                    path = [0] + start.get(part, [])
                    shared = len(path) - 1
                else:
                    shared = common_prefix(before, word)
                del path[shared + 1:]
                base = part + 1 << _NODE_BITS
                tail = common_prefix(word, last[part])
                for depth in range(shared + 1, len(word) + 1):
                    if depth <= tail:
                        path.append(base | _TAIL | depth)
                    else:
                        fresh += 1
                        path.append(base | fresh)
                out.append((base | row, list(path)))
                before, row = word, row + 1
            yield pd.DataFrame({"word": batch["word"], "number": [n for n, _ in out], "nodes": [p for _, p in out]})

    return ordered.mapInPandas(number, "word string, number long, nodes array<long>")


def pairs(numbered: DataFrame) -> DataFrame:
    """Columns before, after, number, n, skip and canon: every skipped pair and every cut pair of all words.

    Of equal code points in a row only the first is canonical: skipping any of them leaves the same word.
    """
    back = trie_nodes(numbered, True).select("word", F.reverse("nodes").alias("after"))
    both = numbered.select(F.col("nodes").alias("before"), "number", "n", "word", F.split("word", "").alias("letters")).join(back, "word")
    length = F.size("before") - 1
    skips = F.transform(F.sequence(F.lit(0), length - 1), lambda i: F.struct(
        F.get("before", i).alias("before"), F.get("after", i + 1).alias("after"), F.lit(True).alias("skip"),
        ((i == 0) | (F.get("letters", i - 1) != F.get("letters", i))).alias("canon")))
    cuts = F.transform(F.sequence(F.lit(0), length), lambda i: F.struct(
        F.get("before", i).alias("before"), F.get("after", i).alias("after"), F.lit(False).alias("skip"), F.lit(False).alias("canon")))
    return both.select("number", "n", F.explode(F.concat(skips, cuts)).alias("pair")).select("pair.*", "number", "n")


def neighbours(numbered: DataFrame) -> DataFrame:
    """Columns number, n_near and best (n and the negated number of the near word of largest n) of all words that have one.

    numbered has the columns word, n, number and nodes, the last two from the forward trie.

    The words of a pair are one word cut there and one a letter of the alphabet at most, so groups are small whatever the data.
    Each sees how many others there are and the best of them; no list of word pairs is made.
    """
    member = F.struct("n", (-F.col("number")).alias("turned"), "skip", "canon")
    groups = pairs(numbered).groupBy("before", "after").agg(F.sort_array(F.collect_list(member), False).alias("all")).where(F.size("all") > 1)
    split = groups.select("all", F.filter("all", lambda m: m["skip"]).alias("skips"), F.filter("all", lambda m: m["skip"] & m["canon"]).alias("shorter"),
                          F.get(F.filter("all", lambda m: ~m["skip"]), F.lit(0)).alias("cut"))
    seen = split.select("skips", "shorter", "cut", F.explode("all").alias("own"))
    own = F.col("own.turned")
    # with a skip: the others with a skip and, from the first place of a run, the word cut here; without: the words one longer
    top = lambda list_, k: F.get(list_, F.lit(k))
    other = F.when(top("skips", 0)["turned"] == own, top("skips", 1)).otherwise(top("skips", 0))
    plain = lambda m: F.when(m.isNotNull(), F.struct(m["n"].alias("n"), m["turned"].alias("turned")))
    meets = F.col("own.canon") & F.col("cut").isNotNull()
    best = F.when(F.col("own.skip"), F.greatest(plain(other), F.when(meets, plain(F.col("cut"))))).otherwise(plain(top("shorter", 0)))
    near = F.when(F.col("own.skip"), F.size("skips") - 1 + meets.cast("int")).otherwise(F.size("shorter"))
    return (seen.select((-own).alias("number"), near.cast("long").alias("near"), best.alias("best"))
            .groupBy("number").agg(F.sum("near").alias("n_near"), F.max("best").alias("best")).where("n_near > 0"))


def roots(forms: DataFrame) -> DataFrame:
    """Columns number and root: the end of the chain of forms that starts at each number."""
    reached = forms.select("number", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        ahead = reached.select(F.col("number").alias("root"), F.col("root").alias("ahead"))
        reached = tabled(reached.join(ahead, "root", "left").select("number", F.coalesce("ahead", "root").alias("root")))
    return reached


def variants(docs: DataFrame, key: str = "doc_id", text: str = "text", every: int = 31) -> DataFrame:
    """Columns word, form, root, n, n_near and form_n: one row per word of seven or more letters that occurs twice or more.

    Words are maximal runs of letters with A-Z lower-cased, less one code point where `every` divides the checksum of key and run.
    form is the near word (one code point inserted, deleted or replaced) of largest n, ties to the smallest word, if its n is ten times the
    word's or more, else null; root is the end of the chain of forms, the word itself without one. Null texts have no words; a null key
    reads as empty; repeated rows count each; other columns are dropped. An empty table gives an empty result.
    """
    words = tabled(counts(docs, key, text, every))
    numbered = tabled(trie_nodes(words, False).join(words, "word"))
    named = numbered.select(F.col("number").alias("own"), "word")
    linked = numbered.join(neighbours(numbered), "number", "left").withColumn("form", F.when(F.col("best.n") >= LEAD * F.col("n"), -F.col("best.turned")))
    linked = tabled(linked.select("number", "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form", F.when(F.col("form").isNotNull(), F.col("best.n")).alias("form_n")))
    ends = roots(linked.where("form is not null"))
    ends = ends.join(named.select(F.col("own").alias("root"), F.col("word").alias("root_word")), "root").select("number", "root_word")
    forms = named.select(F.col("own").alias("form"), F.col("word").alias("form_word"))
    return (linked.join(forms, "form", "left").join(ends, "number", "left")
            .select("word", F.col("form_word").alias("form"), F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"))
