"""Byte-level BPE encoding and decoding by recursive DuckDB queries, one database per Python worker.

A text is cut by the pattern into pieces (for the public pattern by way of chunks, cut at white space, that a worker may have met).
New pieces become token-position rows, each with its own and the next token; a recursive query joins them to the merge table
and contracts each piece's leftmost pair of least rank until no piece has a pair left, and gives the tokens in order; the
vocabulary gives their decoded bytes. A piece's ids do not depend on its neighbours, so a worker keeps those of the
chunks and pieces met last, up to a size that bounds its memory and changes no result.

Before the query, pairs of bytes that nothing can part are contracted at once. Tokens only grow, so a pair is parted only by a
merge of its first byte behind a token that ends with the byte before, of at most the pair's rank (of equals the left one comes
first), or of its second byte in front of a token that begins with the byte after, of a lesser rank. The least ranks of such
merges by two bytes are small tables. Where both are too high, the pair is contracted sooner or later, and doing it at once changes
nothing unless the new token makes a pair of lesser rank; pairs with such a token are left to the query. Two such pairs never
overlap, for the rank of the one would be less than the other's and not less.

A query takes as many rounds as its longest piece has merges, so a long piece is contracted in windows that overlap by half.
Two windows are joined at a token that both have at the same place. That is exact: a sequence of tokens is the encoding of its
bytes if and only if each two neighbours are the encoding of theirs (until some merge first crosses a border, both sides
evolve as if they were alone, so it would cross it in the two tokens' own encoding too), and neighbours in the joined sequence are
neighbours in a window. Where two windows share no token, as in a repeated sign whose tokens fall out of phase, the piece is
contracted in wider ones, in the end as a whole, and a round contracts every place of the least rank at once. That is the same
as one after the other, from the left, unless the new token makes a pair of lesser rank; tokens that can are marked in the
merge table, and of those a round contracts the leftmost alone.
"""

from __future__ import annotations

import base64
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BinaryType, IntegerType, LongType, StringType, StructType

from tallyforge.llm.shared import held, with_python

#: Code points with the property White_Space, as the inside of a character class. Fixed values.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Texts are cut here first, at places that no piece of public_tokenizers.PATTERN crosses: Latin letters up to white space or an
#: ASCII mark, white space without its last mark, all else up to white space with a space before, single white space.
CHUNK = rf" ?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]++(?![^{SPACE}!-/:-@\[-`{{-~])|[{SPACE}]+(?![^{SPACE}])| ?[^{SPACE}]+|[{SPACE}]"
#: Bytes that the chunks and pieces which a worker keeps may take, about; bytes of pieces in one recursive query; characters cut
#: into pieces at once; bytes between the starts of a long piece's windows, which are twice as long.
KEPT, AT_ONCE, CHARS, STEP = 100_000_000, 80_000, 1_000_000, 128
#: Times that windows grow where two share no token.
WIDER = 16
#: The rank of a merge that there is not, above all others.
NEVER = 2**31 - 1

CONTRACT = """
WITH RECURSIVE s(moves, w, p, t, u) AS (
  SELECT true, w, p, t, u FROM given_pieces
  UNION ALL
  (WITH hits AS (SELECT w, min(m * 4294967296 + p) AS mp FROM s JOIN merges ON pair = t::BIGINT * 4294967296 + u WHERE u >= 0 AND moves GROUP BY w),
        least AS (SELECT w, (mp % 4294967296)::INT AS hit, (mp // 4294967296)::INT AS m FROM hits)
   SELECT hit IS NOT NULL, s.w, CASE WHEN s.p > hit THEN s.p - 1 ELSE s.p END,
          CASE WHEN s.p = hit + 1 THEN m ELSE t END, CASE WHEN s.p = hit - 1 THEN m ELSE u END
   FROM s LEFT JOIN least ON s.w = least.w WHERE moves AND s.p IS DISTINCT FROM hit)
)
SELECT w, t FROM s WHERE NOT moves ORDER BY w, p
"""
#: The same, all places of a word's least rank in one round: of places next to each other every second one, from the left.
CONTRACT_ALL = """
WITH RECURSIVE s(moves, w, p, t, u) AS (
  SELECT true, w, p, t, u FROM given_pieces
  UNION ALL
  (WITH pairs AS (SELECT w, p, m, alone FROM s JOIN merges ON pair = t::BIGINT * 4294967296 + u WHERE u >= 0 AND moves),
        least AS (SELECT w, min(m) AS m FROM pairs GROUP BY w),
        met AS (SELECT w, p, m, alone, row_number() OVER (PARTITION BY w ORDER BY p) AS n FROM pairs JOIN least USING (w, m)),
        runs AS (SELECT *, row_number() OVER (PARTITION BY w, p - n ORDER BY p) AS k FROM met),
        hits AS (SELECT w, p, m FROM runs WHERE k % 2 = 1 AND (n = 1 OR NOT alone)),
        placed AS (SELECT s.w, s.p, s.t, s.u, h.m, lag(h.m) OVER o AS inside, lead(h.m) OVER o AS next_m, lead(s.u) OVER o AS after, lead(h.m, 2) OVER o AS after_m,
                     count(h.m) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS gone
                   FROM s LEFT JOIN hits h ON s.w = h.w AND s.p = h.p WHERE moves WINDOW o AS (PARTITION BY s.w ORDER BY s.p))
   SELECT least.w IS NOT NULL, placed.w, (p - gone)::INT, coalesce(placed.m, t)::INT, (CASE WHEN placed.m IS NULL THEN coalesce(next_m, u) ELSE coalesce(after_m, after) END)::INT
   FROM placed LEFT JOIN least ON placed.w = least.w WHERE inside IS NULL)
)
SELECT w, t FROM s WHERE NOT moves ORDER BY w, p
"""
#: Ids of many sequences (w, p, id) -> hexadecimal bytes of each.
DECODE = "SELECT w, string_agg(h, '' ORDER BY p) FROM ids JOIN vocab USING (id) GROUP BY w"


def _class(kind: str) -> str:
    """The inside of a character class of all code points whose category starts with kind."""
    import sys
    import unicodedata

    found, start = [], None
    for i in range(sys.maxunicode + 2):
        inside = i <= sys.maxunicode and unicodedata.category(chr(i)).startswith(kind)
        if inside and start is None:
            start = i
        elif not inside and start is not None:
            found.append(f"\\U{start:08x}-\\U{i - 1:08x}")
            start = None
    return "".join(found)


def joined(parts: list[tuple[list[int], list[int]]], step: int) -> list[int] | None:
    """Ids of the whole from (ids, their bytes' numbers) of windows that start step bytes apart; None if two share no token."""
    ids, begins, ends = [], [], []
    for k, (new, sizes) in enumerate(parts):
        new_ends = list(accumulate(sizes, initial=k * step))
        new_begins = new_ends[:-1]
        del new_ends[0]
        first = 0
        if k:
            low = bisect_right(ends, k * step)
            had = {span: low + i for i, span in enumerate(zip(begins[low:], ends[low:]))}
            both = next((i for i, span in enumerate(zip(new_begins, new_ends)) if span in had), None)
            if both is None:
                return None
            cut = had[new_begins[both], new_ends[both]] + 1
            del ids[cut:], begins[cut:], ends[cut:]
            first = both + 1
        ids += new[first:]
        begins += new_begins[first:]
        ends += new_ends[first:]
    return ids


class Codec:
    """Encoder and decoder of one rank file; pattern cuts a text into pieces."""

    def __init__(self, ranks_path: str, pattern: str):
        import re

        import duckdb
        import numpy as np
        import public_tokenizers

        with open(ranks_path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.own = pattern == public_tokenizers.PATTERN
        letters, numbers = _class("L"), _class("N")
        for mark, inside in ((r"[^\s\p{L}\p{N}]", f"[^{SPACE}{letters}{numbers}]"), (r"\p{L}", f"[{letters}]"), (r"\p{N}", f"[{numbers}]"), (r"\S", f"[^{SPACE}]"), (r"\s", f"[{SPACE}]")):
            pattern = pattern.replace(mark, inside)
        found = re.compile(pattern)
        self.pieces = found.findall if not found.groups else lambda x: [m[0] for m in found.finditer(x)]
        self.chunks = re.compile(CHUNK).findall if self.own else self.pieces  # another pattern's pieces may cross the chunks
        self.db = duckdb.connect(config={"threads": 1, "memory_limit": "70MB", "preserve_insertion_order": False})
        merges = [((self.ranks[t[:i]] << 32) + self.ranks[t[i:]], r) for t, r in self.ranks.items() for i in range(1, len(t)) if t[:i] in self.ranks and t[i:] in self.ranks]
        lesser = {token for pair, r in merges for token in (pair >> 32, pair & 0xFFFFFFFF) if token > r}  # these may make a pair of lesser rank
        alone = pa.array([r in lesser for _, r in merges])
        self._table("merges", pair=pa.array([x for x, _ in merges], pa.int64()), m=pa.array([x for _, x in merges], pa.int64()), alone=alone)
        self._table("vocab", id=pa.array(self.ranks.values(), pa.int32()), h=pa.array([t.hex() for t in self.ranks]))
        self.names, self.tokens = pa.array([str(r) for r in self.ranks.values()]), pa.array(list(self.ranks), pa.binary())
        self.sizes = np.array([len(t) for t in self.ranks])
        self.row = np.zeros(max(self.ranks.values()) + 1, dtype=np.int32)  # of each id its place in names and tokens
        self.row[list(self.ranks.values())] = np.arange(len(self.ranks))
        self.one = np.array([self.ranks[bytes([i])] for i in range(256)], dtype=np.int32)
        self.safe, self.behind, self.before = (np.full((257, 257), NEVER, dtype=np.int32) for _ in range(3))  # by two bytes; 256: none
        for t, r in self.ranks.items():
            if len(t) == 2 and r not in lesser:
                self.safe[t[0], t[1]] = r
            if len(t) > 1 and t[:-1] in self.ranks:
                self.behind[t[-2], t[-1]] = min(self.behind[t[-2], t[-1]], r)
            if len(t) > 1 and t[1:] in self.ranks:
                self.before[t[0], t[1]] = min(self.before[t[0], t[1]], r)
        self.known: dict[str, tuple[str, bytes]] = {}
        self.older: dict[str, tuple[str, bytes]] = {}
        self.size = 0

    def _table(self, name: str, **columns: pa.Array) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def _contracted(self, words: list[bytes], query: str = CONTRACT) -> list[tuple[str, bytes]]:
        """Of each word its ids (decimal, comma after comma) and their decoded bytes."""
        import numpy as np

        lengths = np.array([len(x) for x in words])
        ends = np.cumsum(lengths)
        b = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.intp)
        last, after = np.insert(b[:-1], 0, 256), np.append(b[1:], 256)
        last[ends[:-1]] = after[ends - 1] = 256
        rank = self.safe[b, after]
        sure = (rank < self.behind[last, b]) & (rank <= self.before[after, np.append(after[1:], 256)])
        stay = np.insert(~sure[:-1], 0, True)
        t, w = np.where(sure, rank, self.one[b])[stay], np.repeat(np.arange(len(words), dtype=np.int32), lengths)[stay]
        u = np.where(np.append(w[1:], -1) == w, np.append(t[1:], -1), -1)
        self.db.register("given_pieces", pa.table({"w": w, "p": np.arange(len(t), dtype=np.int32), "t": t, "u": u.astype(np.int32)}))
        found = self.db.sql(query).to_arrow_table()
        return self._written(found.column(1).to_numpy(), np.bincount(found.column(0).to_numpy(), minlength=len(words)))

    def _written(self, ids, counts) -> list[tuple[str, bytes]]:
        """Of sequences of so many ids, one behind the other, their ids in decimal, comma after comma, and their decoded bytes."""
        import numpy as np
        import pyarrow.compute as pc

        rows, ends = pa.array(self.row[ids]), pa.array(np.append(0, np.cumsum(counts)), pa.int32())
        texts, decoded = (pc.binary_join(pa.ListArray.from_arrays(ends, x.take(rows)), gap) for x, gap in ((self.names, ","), (self.tokens, b"")))
        return list(zip(texts.to_numpy(zero_copy_only=False).tolist(), decoded.to_numpy(zero_copy_only=False).tolist()))

    def _in_turns(self, words: list[bytes], query: str = CONTRACT) -> list[tuple[str, bytes]]:
        """_contracted() by queries of AT_ONCE bytes, words of like lengths together so that their rounds end together."""
        import numpy as np

        lengths = np.array([len(x) for x in words], dtype=np.int64)
        order = np.argsort(lengths, kind="stable")
        ends = np.cumsum(lengths[order])
        order = order.tolist()
        found: list = [None] * len(words)
        at = 0
        while at < len(order):
            first, at = at, max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + AT_ONCE, "right")))
            for i, x in zip(order[first:at], self._contracted([words[i] for i in order[first:at]], query)):
                found[i] = x
        return found

    def _encoded(self, pieces: list[str]) -> list[tuple[str, bytes]]:
        """Of each piece its ids (decimal, comma after comma) and their decoded bytes. A piece that is a token stays whole."""
        import numpy as np

        words = [x.encode() for x in pieces]
        found: list = [(str(self.ranks[b]), b) if b in self.ranks else None for b in words]
        short = [i for i, b in enumerate(words) if found[i] is None and len(b) <= 2 * STEP]
        step, left = STEP, [i for i, b in enumerate(words) if found[i] is None and len(b) > 2 * STEP]
        for i, x in zip(short, self._in_turns([words[i] for i in short])):
            found[i] = x
        while left:
            windows = [(i, words[i][a : a + 2 * step]) for i in left for a in range(0, max(1, len(words[i]) - step), step)]
            parts: dict[int, list] = {}
            for (i, _), (x, _) in zip(windows, self._in_turns([b for _, b in windows], CONTRACT if step == STEP else CONTRACT_ALL)):
                ids = list(map(int, x.split(",")))
                parts.setdefault(i, []).append((ids, self.sizes[self.row[ids]].tolist()))
            for i in left:
                if ids := joined(parts[i], step):
                    [found[i]] = self._written(np.array(ids), [len(ids)])
            step, left = WIDER * step, [i for i in left if found[i] is None]
        return found

    def decoded(self, sequences: list[list[int]]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        import numpy as np

        lengths = np.array([len(s) for s in sequences], dtype=np.int64)
        ids = np.array([i for s in sequences for i in s], dtype=np.int32)
        w = np.repeat(np.arange(len(sequences), dtype=np.int32), lengths)
        self.db.register("ids", pa.table({"w": w, "p": np.arange(len(ids)), "id": ids}))
        found = dict(self.db.sql(DECODE).fetchall())
        return [bytes.fromhex(found.get(i, "")) for i in range(len(sequences))]

    def texts(self, texts: list[str | None]) -> Iterator[list[tuple[str, bytes]]]:
        """For each text its pieces' ids and bytes; a null is empty. Texts are taken in groups of about CHARS, one set of queries each."""
        at = 0
        while at < len(texts):
            group, size = [], 0
            while at < len(texts) and size < CHARS:
                group.append(self.chunks(texts[at] or ""))
                size += len(texts[at] or "")
                at += 1
            self.learn(set().union(*group))
            for chunks in group:
                yield list(map(self.known.__getitem__, chunks))

    def learn(self, chunks: set[str]) -> None:
        """Sees to it that all these chunks are known."""
        if self.size > KEPT // 2:
            self.known, self.older, self.size = {}, self.known, 0
        known, older = self.known, self.older
        cut, new, back = {}, [], []
        for x in chunks.difference(known):
            if x in older:
                back.append(x)
            elif not self.own or (x[1:] if x[0] == " " else x).isalpha() or len(parts := self.pieces(x)) == 1:
                new.append(x)  # one piece
            else:
                cut[x] = parts
        for x in set().union(*cut.values()).difference(known, new, back):
            (back if x in older else new).append(x)
        self._keep(back, [older[x] for x in back])
        self._keep(new, self._encoded(new))
        both = [zip(*[known[y] for y in parts]) for parts in cut.values()]
        self._keep(cut, [(",".join(ids), b"".join(decoded)) for ids, decoded in both])

    def _keep(self, parts: Iterable[str], entries: list[tuple[str, bytes]]) -> None:
        self.known.update(zip(parts, entries))
        self.size += sum([200 + len(ids) + 2 * len(decoded) for ids, decoded in entries])


def codec(ranks_path: str, pattern: str) -> Codec:
    """This worker's codec; it stays for the next tasks."""
    return held(("bpe", ranks_path, pattern), lambda: Codec(ranks_path, pattern))


def encode(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with ids array<int>: the whole text's tokens, without special tokens. Null and empty texts: no ids. Texts, repeated or
    very long, are each encoded whole; columns of df named like the new one, in any case, are replaced."""

    def make(texts: list) -> list[pa.Array]:
        c = codec(ranks_path, pattern)
        return [pa.array([[int(i) for x, _ in pieces for i in x.split(",")] for pieces in c.texts(texts)], pa.list_(pa.int32()))]

    return with_python(df, text, StructType().add("ids", ArrayType(IntegerType())), make)


def decode(df: DataFrame, ranks_path: str, pattern: str, ids: str = "ids") -> DataFrame:
    """df with decoded binary: the bytes of the ids, by an ordered aggregation. Null and empty: no bytes; unknown ids give none."""

    def make(sequences: list) -> list[pa.Array]:
        return [pa.array(codec(ranks_path, pattern).decoded([s or [] for s in sequences]), pa.binary())]

    return with_python(df, ids, StructType().add("decoded", BinaryType()), make)


def digests(df: DataFrame, ranks_path: str, pattern: str, text: str = "text") -> DataFrame:
    """df with n_tokens, ids_sha256 and decoded_sha256 of encoding each whole text and decoding the ids again.

    Null and empty texts: 0 tokens and the digests of nothing. Very long texts are encoded whole, a piece without any gap too, in
    time that grows with its length. Repeated rows are kept; columns of df named like a new one, in any case, are replaced.
    """
    from hashlib import sha256

    def make(texts: list) -> list[pa.Array]:
        found = []
        for pieces in codec(ranks_path, pattern).texts(texts):
            ids = ",".join([x for x, _ in pieces])
            found.append((ids.count(",") + 1 if ids else 0, sha256(ids.encode()).hexdigest(), sha256(b"".join([b for _, b in pieces])).hexdigest()))
        return [pa.array([x[k] for x in found], kind) for k, kind in enumerate((pa.int64(), pa.string(), pa.string()))]

    return with_python(df, text, StructType().add("n_tokens", LongType()).add("ids_sha256", StringType()).add("decoded_sha256", StringType()), make)
