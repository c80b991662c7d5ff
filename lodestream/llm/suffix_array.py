"""Suffix arrays by linear grouping, and exact substring dedup of documents as UTF-8 bytes.

`suffix_array` sorts in two phases. The first splits the suffixes into groups of equal Lyndon prefixes: groups are taken
in descending order; each suffix of a group finds its pointer to the previous suffix of a lower group, and the suffixes
that are pointed to leave the lower part of their own group, those pointed to more often above those pointed to less.
The second goes through the order from its low end and puts each suffix's chain of previous-smaller pointers to the
front of their groups. No names are given and nothing recurs.

`dedup` removes each byte that a `length`-byte string covers which also starts in a document with a smaller doc_id
(`lodestream.llm.repeats` says how the places are found). Strings are judged on the input; matches do not cross
documents. Null texts count as empty. What is left of a text may be cut within a character: `op6` digests the bytes,
`deduplicated` drops the rest of such a character. Very long texts are one block of their own size. Rows with a null
doc_id are returned as they are; repeated rows and rows with one doc_id are one document, which removes nothing from itself.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestream.llm.repeats import Block, Spec, U, _tables, before, mix, repeats

LENGTH = 50
#: Bytes of surroundings that are looked at together; their shared stretches make one suffix array.
TEXT = 1 << 19


def suffix_array(s: list[int]) -> list[int]:
    """Order of all suffixes of `s`, whose symbols are integers from 0."""
    n = len(s)
    if n < 2:
        return list(range(n))
    # A sentinel below all symbols stands at n.
    order = sorted(range(n), key=s.__getitem__)
    sa = [n, *order]
    place = [0] * (n + 1)  # where a suffix stands in sa
    group = [0] * (n + 1)  # where its group starts
    size = [0] * (n + 1)  # of the group that starts here
    start = 0
    for i in range(n + 1):
        x = sa[i]
        place[x] = i
        if i == 0 or i == 1 or s[x] != s[sa[i - 1]]:
            start = i
        group[x] = start
        size[start] += 1
    prev = [-1] * (n + 1)
    done = n + 1  # groups from here on have been taken
    while done > 0:
        # The highest group that has not been taken.
        start = group[sa[done - 1]]
        end = start + size[start]
        members = sa[start:end]
        if len(members) > 1:
            members.sort()
        times: dict[int, int] = {}
        for x in members:
            p = x - 1
            while p >= 0 and group[p] >= start:
                p = prev[p]
            prev[x] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        done = start
        if not times:
            continue
        most = max(times.values())
        if most == 1:
            levels = [list(times)]
        else:
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            levels = [by[k] for k in sorted(by, reverse=True)]
        for level in levels:
            moved: dict[int, int] = {}
            for p in level:  # to the end of its group
                g = group[p]
                k = moved.get(g, 0) + 1
                moved[g] = k
                to = g + size[g] - k
                at = place[p]
                if at != to:
                    other = sa[to]
                    sa[at], sa[to] = other, p
                    place[other], place[p] = at, to
            for p in level:
                g = group[p]
                k = moved[g]
                if k < size[g]:
                    group[p] = g + size[g] - k
            for g, k in moved.items():
                whole = size[g]
                if k < whole:
                    size[g + whole - k] = k
                    size[g] = whole - k
    out = [0] * (n + 1)
    out[0] = n
    front = group[:]  # next free place of the group that starts here, by its start
    free = list(range(n + 1))
    placed = [False] * (n + 1)
    placed[n] = True
    for i in range(n + 1):
        x = out[i] - 1
        while x >= 0 and not placed[x]:
            g = front[x]
            out[free[g]] = x
            free[g] += 1
            placed[x] = True
            x = prev[x]
    return out[1:]


def _window_hashes(flat: np.ndarray, length: int) -> np.ndarray:
    (power, inverse), (power2, inverse2) = _tables(len(flat) + 1)
    code = mix(flat.astype(np.uint64) + U(1))
    out = np.zeros(max(0, len(flat) - length + 1), np.uint64)
    for p, q in ((power, inverse), (power2, inverse2)):
        sums = np.zeros(len(flat) + 1, np.uint64)
        np.cumsum(code * p[: len(flat)], out=sums[1:])
        out = out * U(3) + mix((sums[length:] - sums[:-length]) * q[: len(out)])
    return out


def holders(texts: list[bytes]) -> list[tuple[bytes, int]]:
    """For each text one of the texts that it begins or ends, or itself, and where it stands in that."""
    whole: dict[bytes, tuple[bytes, int]] = {}
    last = b""
    for t in sorted(set(texts), reverse=True):
        last = last if last.startswith(t) else t
        whole[t] = (last, 0)
    last = b""
    ends: dict[bytes, tuple[bytes, int]] = {}
    for r in sorted({t[::-1] for t, _ in whole.values()}, reverse=True):
        last = last if last.startswith(r) else r
        ends[r[::-1]] = (last[::-1], len(last) - len(r))
    return [ends[whole[t][0]] for t in texts]


def window_classes(texts: list[bytes], length: int) -> np.ndarray:
    """Equal numbers for equal windows, by the places where they start in the texts, one after the other with a gap of one."""
    places = np.cumsum([0, *(len(t) + 1 for t in texts)])
    symbols = np.zeros(int(places[-1]), np.int64)
    for at, t in zip(places[:-1].tolist(), texts, strict=True):
        symbols[at : at + len(t)] = np.frombuffer(t, np.uint8) + np.int64(1)
    sa = np.array(suffix_array(symbols.tolist()), np.int64)
    sa = sa[sa + length < places[np.searchsorted(places, sa, "right")]]
    rows = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int16), length)[sa]
    new = np.append(True, (rows[1:] != rows[:-1]).any(axis=1)) if len(sa) else np.zeros(0, bool)
    out = np.full(int(places[-1]), -1)
    out[sa] = np.cumsum(new) - 1
    return out


def shared_windows(groups: np.ndarray, sequences: list[np.ndarray], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that stand in more than one sequence, or more than once: (sequence, offset, class of equal windows).

    Hashes only set aside windows without any equal; equality is decided in the suffix array of what remains, each
    distinct stretch once, in parts of about `TEXT` bytes that hold whole groups.
    """
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    classes = 0
    sizes = np.fromiter(map(len, sequences), np.int64, len(sequences))
    order = np.argsort(groups, kind="stable")
    cuts = np.flatnonzero(np.append(True, groups[order][1:] != groups[order][:-1])).tolist() + [len(order)]
    low = 0
    while low < len(cuts) - 1:
        high, total = low, 0
        while high < len(cuts) - 1 and (high == low or total < TEXT):
            total += int(sizes[order[cuts[high] : cuts[high + 1]]].sum())
            high += 1
        own = order[cuts[low] : cuts[high]]
        low = high
        flat = np.concatenate([sequences[i] for i in own])
        ends = np.cumsum(sizes[own])
        starts = ends - sizes[own]
        n = np.maximum(0, sizes[own] - length + 1)
        of = np.repeat(np.arange(len(own)), n)
        offset = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        hashed = _window_hashes(flat, length)[starts[of] + offset]
        _, inverse, times = np.unique(hashed, return_inverse=True, return_counts=True)
        again = times[inverse] > 1
        if not again.any():
            continue
        of, offset = of[again], offset[again]
        first = np.flatnonzero(np.append(True, of[1:] != of[:-1]))
        last = np.append(first[1:], len(of)) - 1
        raw = flat.tobytes()
        stretches: dict[bytes, int] = {}
        known = [stretches.setdefault(raw[a:b], len(stretches)) for a, b in zip((starts[of[first]] + offset[first]).tolist(), (starts[of[first]] + offset[last] + length).tolist(), strict=True)]
        texts = list(stretches)
        places = np.cumsum([0, *(len(t) + 1 for t in texts)])
        # Windows of a group that has one stretch are equal where they stand at one offset; the others are compared.
        group = groups[own[of[first]]]
        pairs = np.unique(np.stack([group, np.array(known)], 1), axis=0)
        several = np.bincount(np.unique(pairs[:, 0], return_inverse=True)[1])
        compared = np.unique(pairs[np.repeat(several > 1, several), 1])
        cls = np.arange(int(places[-1])) + classes
        classes += int(places[-1])
        if len(compared):
            within = holders([texts[k] for k in compared])
            held = list(dict.fromkeys(t for t, _ in within))
            at_of = dict(zip(held, np.cumsum([0, *(len(t) + 1 for t in held[:-1])]).tolist(), strict=True))
            new = window_classes(held, length) + classes
            classes += len(new)
            for k, (t, shift_in) in zip(compared.tolist(), within, strict=True):
                n_own, at = len(texts[k]) - length + 1, at_of[t] + shift_in
                cls[places[k] : places[k] + n_own] = new[at : at + n_own]
        shift = np.zeros(len(own), np.int64)
        shift[of[first]] = places[np.array(known)] - offset[first]
        out.append((own[of], offset, cls[shift[of] + offset]))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spec(length: int = LENGTH, gram: int = 24, block_bytes: int = 8 << 20) -> Spec:
    if not 0 < gram <= length or length - gram + 1 > 63:
        raise ValueError("gram: at most length, and at least length - 62")
    return Spec("suffix-array", False, length, gram, block_bytes, lambda groups, sequences: shared_windows(groups, sequences, length))


def _runs(block: Block, covered: np.ndarray) -> np.ndarray:
    """How many runs of covered bytes each document has."""
    rise = covered & ~np.append(False, covered[:-1])
    inner = block.starts[1:-1]
    rise[inner[inner < block.n]] |= covered[inner[inner < block.n]]
    return np.diff(before(rise, block.starts))


def _digests(rows: pa.Table, block: Block, covered: np.ndarray) -> pa.Table:
    kept = block.raw[~covered].tobytes()
    gone = before(covered, block.starts)
    ends = block.starts - gone
    sums = [hashlib.sha256(kept[a:b]).hexdigest() for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
    return pa.Table.from_arrays([rows["doc_id"], pa.array(np.diff(block.starts)), pa.array(np.diff(gone)), pa.array(_runs(block, covered).astype(np.int64)), pa.array(sums, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def dedup(docs: DataFrame, own: Spec | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each of `docs` (doc_id, text)."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return repeats(rows, own or spec(), _digests, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def deduplicated(docs: DataFrame, own: Spec | None = None) -> DataFrame:
    """`docs` with what is left of their texts; a column n_chars, if there is one, is the new length. Null texts become empty."""
    columns = docs.columns

    def finish(rows: pa.Table, block: Block, covered: np.ndarray) -> pa.Table:
        kept = block.raw[~covered].tobytes()
        ends = block.starts - before(covered, block.starts)
        texts = [kept[a:b].decode("utf-8", "ignore") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
        new = {"text": pa.array(texts, pa.string()), "n_chars": pa.array(map(len, texts), pa.int64())}
        return pa.table({c: new.get(c, rows[c]) for c in columns})

    rows = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    if "n_chars" in columns:
        rows = rows.withColumn("n_chars", F.col("n_chars").cast("long"))
    return repeats(rows, own or spec(), finish, rows.schema)


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Texts as hexadecimal digits, two a byte. Rows with a null doc_id take no part.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS k, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
b AS (SELECT k, doc_id, h, unnest(range(length(h) // 2)) AS i FROM d),
w AS (SELECT k, i, doc_id > min(doc_id) OVER (PARTITION BY substr(h, 2 * i + 1, 100)) AS again FROM b WHERE 2 * i + 100 <= length(h) AND doc_id IS NOT NULL),
c AS (SELECT b.k, b.i, substr(h, 2 * i + 1, 2) AS byte, coalesce(bool_or(again) OVER (PARTITION BY b.k ORDER BY b.i ROWS BETWEEN 49 PRECEDING AND CURRENT ROW), false) AS gone FROM b LEFT JOIN w USING (k, i)),
s AS (SELECT *, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY k ORDER BY i), false) AS rises FROM c),
a AS (SELECT k, count(*) FILTER (gone) AS n_removed, count(*) FILTER (rises) AS n_spans, string_agg(byte, '' ORDER BY i) FILTER (NOT gone) AS kept FROM s GROUP BY k)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN a USING (k)
"""
