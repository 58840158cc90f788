"""SimHash against a bit-by-bit version, and its components against all pairs."""

import re
from collections import Counter

import numpy as np
import pytest
import xxhash
from helpers import empty_documents, odd_documents, prose

from attestra.llm import simhash
from attestra.llm.components import components


def slow_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return 0
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k:k + 3]).encode(), 42) for k in range(max(1, len(words) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, radius=3):
    """Smallest position per component of all pairs."""
    label = list(range(len(prints)))

    def top(n):
        while label[n] != n:
            n = label[n]
        return n

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                x, y = top(a), top(b)
                label[max(x, y)] = min(x, y)
    return [top(n) for n in range(len(prints))]


def test_documents(spark, small):
    rows = spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in simhash.near_duplicates(spark.read.parquet(f"{small}/documents.parquet")).collect()}
    prints = [slow_fingerprint(r["text"]) for r in rows]
    names = slow_components(prints)
    for row, value, name in zip(rows, prints, names):
        assert got[row["doc_id"]]["fingerprint"] == f"{value:016x}"
        assert got[row["doc_id"]]["component_id"] == rows[name]["doc_id"]


def test_odd_rows(spark):
    df, rows = odd_documents(spark)
    got = simhash.near_duplicates(df).collect()
    assert Counter((r["doc_id"], r["fingerprint"]) for r in got) == Counter((k, f"{slow_fingerprint(t):016x}") for k, t in rows)
    assert {r["component_id"] for r in got if r["fingerprint"] == "0" * 16} == {2}
    assert simhash.near_duplicates(empty_documents(spark)).collect() == []
    kept = simhash.representatives(df)
    assert kept.columns == df.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({1: 1, 2: 1, 5: 1, None: 1, 7: 1, 8: 2, 9: 1, 10: 1})
    assert simhash.representatives(empty_documents(spark)).collect() == []


@pytest.mark.parametrize("tile_rows", [3, 64, 4096])
def test_links_keep_every_component(spark, tile_rows):
    random = np.random.default_rng(tile_rows)
    base = random.integers(0, 1 << 63, 30, dtype=np.int64)
    near = [int(b) ^ int(sum(1 << int(k) for k in random.choice(63, random.integers(1, 4), replace=False))) for b in np.repeat(base, 4)]
    chain = [0]
    for k in range(20):
        chain.append(chain[-1] ^ (0b111 << (3 * k)))
    prints = sorted({*map(int, base), *near, *chain})
    found = simhash.links(spark.createDataFrame([(p, [p]) for p in prints], "fp long, codes array<long>"), tile_rows=tile_rows)
    got = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
    names = slow_components([p & (1 << 64) - 1 for p in prints])
    mine = [got.get(p, p) for p in prints]
    assert len(set(zip(mine, names))) == len(set(mine)) == len(set(names))


@pytest.mark.parametrize("tile_rows", [5, 4096])
def test_wide_links_keep_every_component(spark, tile_rows):
    random = np.random.default_rng(8)
    prints = []
    for base in random.integers(0, 1 << 62, (25, 4), dtype=np.int64):
        for flips in (0, 20, 36, 37, 60):
            bits = np.unpackbits(base.view(np.uint8))
            bits[random.choice(256, flips, replace=False)] ^= 1
            prints.append(np.packbits(bits).view(np.int64))
    found = simhash.links(spark.createDataFrame([(k, p.tolist()) for k, p in enumerate(prints)], "fp long, codes array<long>"), 36, tile_rows, 4)
    got = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
    whole = [int.from_bytes(p.tobytes(), "little") for p in prints]
    names = slow_components(whole, 36)
    mine = [got.get(k, k) for k in range(len(prints))]
    assert len(set(zip(mine, names))) == len(set(mine)) == len(set(names)) < len(prints)


def overlap(a, b, words=5):
    a, b = ({tuple(t.lower().split()[k:k + words]) for k in range(max(1, len(t.split()) - words + 1))} for t in (a, b))
    return len(a & b) / len(a | b)


def test_near_copies_leave_one_row(spark):
    """Copies with a shingle overlap of 0.8 or more are found, unrelated texts stay."""
    random = np.random.default_rng(6)
    rows, wanted = [], set()
    for k in range(12):
        text = prose(900 + k, 60).split()
        rows.append((100 * k, " ".join(text)))
        wanted.add(100 * k)
        for n in range(1, 6):
            copy = list(text)
            for at in random.choice(len(text), max(1, len(text) // 60), replace=False):
                copy[at] = f"changed{n}"
            if overlap(" ".join(copy), " ".join(text)) >= 0.8:
                rows.append((100 * k + n, " ".join(copy)))
    assert len(rows) > 40
    kept = simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["doc_id"] for r in kept} == wanted and len(kept) == 12


def slow_groups(texts, least=0.8):
    """Smallest position per component of the pairs whose overlap of shingle sets is at least `least`."""
    label = list(range(len(texts)))
    found = [re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) for t in texts]
    sets = [{tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for w in found]
    for a in range(len(sets)):
        for b in range(a):
            if label[a] != label[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= least:
                x, y = sorted((label[a], label[b]))
                label = [x if v == y else v for v in label]
    return label


@pytest.mark.parametrize("block_bytes", [3000, 1 << 22])
def test_exact_overlap_decides(spark, block_bytes):
    """Pairs of overlap 0.6 to 0.95, chains of links, equal lines and a dense group, in one block of candidates and in many."""
    random = np.random.default_rng(3)
    texts = []
    for k, part in enumerate(np.linspace(0.02, 0.3, 40)):
        words = prose(2000 + k, 12).split()
        other = prose(3000 + k, 12).split()
        cut = int(len(words) * part)
        texts += [" ".join(words), " ".join(words[:len(words) - cut] + other[:cut]), " ".join(words[cut:])]
    chain = prose(5000, 40).split()
    texts += [" ".join(chain[at:at + 150]) for at in range(0, 120, 12)]
    texts += [f"{prose(6000 + k, 40)} " + "the very same line stands here over and over again\n" * 100 for k in range(4)]
    base = prose(7000, 15).split()
    for _ in range(60):
        copy = list(base)
        copy[random.integers(len(copy))] = f"changed{random.integers(1000)}"
        texts.append(" ".join(copy))
    texts += ["a b c d e f g h", "a b c d e f g h i", "a b c d e f g", "A B", "a b", "a b c", "", None, " \n"]
    order = random.permutation(len(texts))
    texts = [texts[k] for k in order]
    label = slow_groups(texts)
    got = simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block_bytes=block_bytes)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label))
    assert len(set(label)) < len(texts) - 60


def test_leading_hashes_of_an_overlap_meet():
    random = np.random.default_rng(8)
    for n in range(1, 60):
        whole = np.unique(random.integers(0, 1 << 62, n).astype(np.uint64))
        for least in (0.5, 0.8, 1.0):
            fewer = int(least * len(whole) + 1e-9)
            if fewer and fewer / len(whole) >= least:
                part = np.sort(random.choice(whole, fewer, replace=False))
                assert set(simhash._leading(whole, least).tolist()) & set(simhash._leading(part, least).tolist())
    assert len(simhash._leading(whole[:0], 0.8)) == 0 and len(simhash._leading(np.arange(15, dtype=np.uint64), 0.8)) == 4


def test_only_fingerprints_with_a_common_hash_are_compared(spark):
    """Equal codes of texts without a common shingle are no candidates, however many they are."""
    rows = [(k, [5, 5], 1, [1000 + k // 2 if k < 20 else 5000 + k]) for k in range(3000)]
    distinct = spark.createDataFrame(rows, "fp long, codes array<long>, n long, leading array<long>")
    found = {tuple(sorted(r)) for r in simhash.shared_links(distinct, 3, 0.8, parts=2).collect()}
    assert found == {(k, k + 1) for k in range(0, 20, 2)}


@pytest.mark.parametrize("tile_rows", [3, 40, 4096])
def test_crowded_hashes_keep_every_link(spark, tile_rows):
    """One line in all texts, texts of many lengths and a large group of near copies, in one tile a hash and in many."""
    random = np.random.default_rng(9)
    line = "a common line that stands in every one of these texts"
    texts = []
    for k in range(45):
        words = prose(4000 + k, 2 + k % 9).split()
        copy = list(words)
        copy[random.integers(len(copy))] = "changed"
        texts += [f"{line} {' '.join(words)}", f"{line} {' '.join(copy)}", f"{line} {' '.join(words[:int(len(words) * 0.85)])}"]
    base = prose(8000, 8).split()
    texts += [" ".join(base[:at] + ["changed"] + base[at + 1:]) for at in range(len(base))]
    label = slow_groups(texts)
    got = simhash.representatives(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), tile_rows=tile_rows)
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(set(label)) and 40 < len(set(label)) < len(texts) - 40


def test_repeated_lines_join_nothing(spark):
    line = "one line of ten words that stands here many times\n"
    rows = [(k, prose(k, 40) + "\n" + line * 100) for k in (1, 2)]
    assert {r["doc_id"] for r in simhash.representatives(spark.createDataFrame(rows, "doc_id long, text string")).collect()} == {1, 2}


def test_columns_of_any_name_keep_their_values(spark):
    names = ["_key", "_row", "row", "s", "fp", "root", "codes", "of_key", "block"]
    rows = [(k, prose(k // 2, 5), *range(10 * k, 10 * k + len(names))) for k in range(6)]
    got = simhash.representatives(spark.createDataFrame(rows, ["doc_id", "text", *names])).collect()
    assert sorted(map(tuple, got)) == rows[::2]


def test_components(spark):
    line = [(k, k + 1) for k in range(300)]
    star = [(1000, 1001 + k) for k in range(200)]
    edges = spark.createDataFrame(line + star + [(5, 5), (None, 7), (1, 2), (2, 1)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges, "a", "b").collect()}
    assert len({got[k] for k in range(301)}) == 1 and len({got[k] for k in range(1000, 1201)}) == 1 and len(set(got.values())) == 2
    assert components(edges.limit(0), "a", "b").collect() == []


@pytest.mark.parametrize("cells", [1, 5, 40, 1 << 20])
@pytest.mark.parametrize("same", [False, True])
def test_blocks_of_a_tile_pair_keep_every_component(monkeypatch, cells, same):
    """Chains and groups whose links lie in several blocks of left rows."""
    monkeypatch.setattr(simhash, "MATRIX_CELLS", cells)
    for seed in range(40):
        random = np.random.default_rng(seed)
        values = np.unique(random.integers(0, 1 << 7, 60)).astype(np.uint64)
        random.shuffle(values)
        table = np.stack([values, values], axis=1)
        left, right = (table, table) if same else (table[:25], table[25:])
        a, b = simhash._joined(left, right, 1, same)
        wanted, got = ({int(v): int(v) for v in values} for _ in range(2))
        links = [(int(x), int(y)) for x in left[:, 1] for y in right[:, 1] if (int(x) ^ int(y)).bit_count() <= 1]
        for names, edges in ((wanted, links), (got, zip(a.tolist(), b.tolist()))):
            for x, y in edges:
                x, y = names[x], names[y]
                for v in names:
                    names[v] = x if names[v] == y else names[v]
        assert len(set(zip(wanted.values(), got.values()))) == len(set(wanted.values())) == len(set(got.values()))


def test_links_of_a_tile_of_several_blocks(spark):
    random = np.random.default_rng(12)
    prints = []
    for _ in range(150):
        bits = np.concatenate([random.permutation([1] * 8 + [0] * 8) for _ in range(4)])
        for _ in range(10):  # equal bit counts, two bits from one to the next
            prints.append(int(np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")[0]))
            word = 16 * int(random.integers(4))
            on, off = (word + int(random.choice(np.flatnonzero(bits[word:word + 16] == k))) for k in (1, 0))
            bits[on], bits[off] = 0, 1
    prints = sorted(set(prints))
    found = simhash.links(spark.createDataFrame([(p, [p]) for p in prints], "fp long, codes array<long>"))
    got = {r["node"]: r["root"] for r in components(found, "a", "b").collect()}
    names = slow_components([p & (1 << 64) - 1 for p in prints])
    assert len(prints) ** 2 > simhash.MATRIX_CELLS
    mine = [got.get(p, p) for p in prints]
    assert len(set(zip(mine, names))) == len(set(mine)) == len(set(names))
