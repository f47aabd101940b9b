"""Byte-level BPE by recursive SQL: DuckDB contracts token rows inside each partition.

A text is split by the tokenizer's pattern. Each distinct piece of a batch becomes rows (piece, position, token, next
token), one for each byte, which are joined to the merge table; from then on a piece is one row with its tokens and the
ranks of their pairs. Every round of a recursive query contracts each piece's leftmost pair of least rank and joins the
two pairs that this makes to the merge table, until no pair merges. Pieces of over LONG_PIECE bytes, of which all rounds
together would not fit, keep their token rows in a table that each round replaces; there a round contracts, besides the
least pair, all pairs that no other can reach before their turn (see _ROUND). Decoding joins token rows to the
vocabulary and concatenates them by an ordered aggregation. A worker keeps pieces that it has encoded in a bounded cache.

Defined cases: a null or empty text has no ids and decodes to no bytes; repeated rows and ids are encoded row by row;
pieces of any length go through SQL; queries are cut by the rows that they hold, within a long document too; other
columns pass unchanged.
"""

from __future__ import annotations

import base64
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import Generations, cached

#: Bytes of text that one round of SQL takes.
BLOCK_BYTES = 1 << 20
#: Pieces over so many bytes are contracted one by one.
LONG_PIECE = 1023
#: Pieces of a generation that a worker remembers.
CACHE = 120_000
#: Pieces that one query takes, and their squared bytes: the recursion keeps the rows of every round, half the square of a piece.
SQL_PIECES, SQL_SQUARES = 32_768, 1 << 23
#: What one query decodes: bytes of tokens, and TOKEN_BYTES for each token besides.
SQL_BYTES, TOKEN_BYTES = 12 << 20, 20
#: What a query may hold at least, and for each byte of a long piece.
MEMORY, MEMORY_BYTE = 256 << 20, 400

_codecs: dict = {}

#: The rank of a pair that does not merge.
_NO = 2**31 - 1
#: A key is piece * 1024 + position. A piece is a list of cells: rank of the pair with the next token, first position,
#: token; so the least cell is the leftmost pair of least rank.
_ENCODE = f"""
WITH RECURSIVE s(word, cells) AS (
    SELECT word, list_transform(cells, lambda x: ((x & {_NO}) << 32) + (x >> 31))
    FROM (SELECT key >> 10 AS word, list_sort(list(((key & 1023) << 47) + (tok::BIGINT << 31) + coalesce(rank, {_NO}))) AS cells
          FROM token_rows t LEFT JOIN merges m ON m.l = t.tok AND m.r = t.after GROUP BY 1)
    UNION ALL
    SELECT word, list_concat(cells[:greatest(p - 2, 0)], CASE WHEN p > 1 THEN [(coalesce(x.rank, {_NO})::BIGINT << 32) + (cells[p - 1] & 4294967295)] ELSE [] END,
                             [(coalesce(y.rank, {_NO})::BIGINT << 32) + (best & 4294901760) + (best >> 32)], cells[p + 2:])
    FROM (SELECT word, cells, best, list_position(cells, best) AS p FROM (SELECT word, cells, list_min(cells) AS best FROM s) WHERE best >> 32 < {_NO}) a
    LEFT JOIN merges x ON x.l = cells[p - 1] & 65535 AND x.r = best >> 32
    LEFT JOIN merges y ON y.l = best >> 32 AND y.r = cells[p + 2] & 65535
)
SELECT word, list_transform(cells, lambda x: (x & 65535)::INTEGER) AS ids FROM s WHERE list_min(cells) >> 32 = {_NO}
"""

#: One round of a long piece, whose rows are long_piece (i, tok, rank of the pair with the next row).
#: A pair of rank r may go before its turn if no smaller rank lies within REACH tokens of it, where no token has more
#: than REACH bytes: whatever merges earlier farther away would have to grow over all of them to touch it. In a run of
#: equal ranks, every second pair from its start goes, if that holds for the start as well. What such pairs make must
#: not have a smaller rank itself, or it would come too early: either no pair with the new token has (early), or not its
#: pairs with the neighbours and itself; a pair for which that fails counts as smaller than r (level). The least pair of
#: all, the leftmost of several, can always go.
_ROUND = f"""
CREATE OR REPLACE TABLE long_piece AS
WITH n AS (
    SELECT i, tok, rank, lag(rank) OVER o IS DISTINCT FROM rank AS opens, lag(tok) OVER o AS left_tok, lead(tok, 2) OVER o AS right_tok
    FROM long_piece WINDOW o AS (ORDER BY i)),
l AS (
    SELECT n.i, n.tok, n.rank, opens, 2 * n.rank::BIGINT - (NOT early AND (twice OR coalesce(x.rank, {_NO}) <= n.rank OR coalesce(y.rank, {_NO}) <= n.rank))::INTEGER AS level
    FROM n LEFT JOIN near_ids ON id = n.rank
    LEFT JOIN near x ON x.l = left_tok AND x.r = n.rank LEFT JOIN near y ON y.l = n.rank AND y.r = right_tok),
a AS (
    SELECT i, tok, rank, opens, min(coalesce(level, 2 * rank::BIGINT)) OVER (ORDER BY i ROWS BETWEEN $reach PRECEDING AND CURRENT ROW) AS before,
           min(coalesce(level, 2 * rank::BIGINT)) OVER (ORDER BY i ROWS BETWEEN CURRENT ROW AND $reach FOLLOWING) AS behind
    FROM l),
b AS (
    SELECT a.*, max(CASE WHEN opens THEN i END) OVER o AS first, max(CASE WHEN opens AND before >= 2 * rank::BIGINT THEN i END) OVER o AS sure
    FROM a WINDOW o AS (ORDER BY i ROWS UNBOUNDED PRECEDING)),
c AS (
    SELECT i, tok, rank, rank < {_NO} AND (i = $least OR before >= 2 * rank::BIGINT AND behind >= 2 * rank::BIGINT AND first = sure AND (i - first) % 2 = 0) AS goes
    FROM b),
d AS (SELECT i, CASE WHEN goes THEN rank ELSE tok END AS tok, lag(goes) OVER (ORDER BY i) AS gone FROM c),
e AS (SELECT i, tok, lead(tok) OVER (ORDER BY i) AS after FROM d WHERE gone IS NOT TRUE)
SELECT row_number() OVER (ORDER BY i) AS i, tok, coalesce(m.rank, {_NO}) AS rank FROM e LEFT JOIN near m ON m.l = tok AND m.r = after
"""

#: The connection has one thread, so rows reach the aggregate in the order of the subquery; ORDER BY within it sorts
#: each group by itself, at four times the cost.
_DECODE = """
SELECT doc, string_agg(chars, '') AS chars
FROM (SELECT doc, chars FROM tokens t JOIN vocabulary v ON v.id = t.id ORDER BY pos) GROUP BY doc
"""


class Codec:
    """The ranks of one file, as SQL tables and as a cache of encoded pieces."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import duckdb
        import regex

        if max(ranks.values()) > 65535:
            raise ValueError("a vocabulary may have 65,536 ids at most")
        self.ranks, self.find = ranks, regex.compile(pattern).findall
        # left, right, rank of all pairs, one after another
        flat = array("i")
        for t, k in ranks.items():
            for i in range(1, len(t)):
                if t[:i] in ranks and t[i:] in ranks:
                    flat.extend((ranks[t[:i]], ranks[t[i:]], k))
        pairs = np.frombuffer(flat, np.int32).reshape(-1, 3)
        self.one = np.array([ranks.get(bytes([b]), -1) for b in range(256)], np.int32)
        if self.one.min() < 0:
            raise ValueError("the vocabulary lacks a single byte")
        self.reach = max(map(len, ranks))
        self.db = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": f"{MEMORY}B", "temp_directory": ""})
        self._table("merges", dict(zip(("l", "r", "rank"), map(np.ascontiguousarray, pairs.T), strict=True)))
        # tokens with a merge of smaller rank, and those that have it with themselves
        left, right, rank = pairs.T
        twice = {*left[(left == right) & (rank < left)].tolist()}
        late = {*left[rank < left].tolist(), *right[rank < right].tolist()}
        self._table("vocabulary", {"id": pa.array(ranks.values(), pa.int32()), "chars": pa.array([t.decode("latin-1") for t in ranks]), "early": pa.array([k not in late for k in ranks.values()]), "twice": pa.array([k in twice for k in ranks.values()])})
        self.cost = np.zeros(max(ranks.values()) + 1, np.int64)
        self.cost[[*ranks.values()]] = [TOKEN_BYTES + len(t) for t in ranks]
        self.cache = Generations()

    def _table(self, name: str, columns: dict) -> None:
        self.db.register("given", pa.table(columns))
        self.db.execute(f"CREATE OR REPLACE TABLE {name} AS SELECT * FROM given")
        self.db.unregister("given")

    def learn(self, pieces: list[str]) -> None:
        """Encodes pieces into the cache."""
        rest: list[str] = []
        raw: list[bytes] = []
        for p in pieces:
            b = p.encode()
            if (k := self.ranks.get(b)) is not None:
                self.cache[p] = np.int32(k).tobytes()
            elif len(b) > LONG_PIECE:
                self.cache[p] = self._contract_long(b)
            else:
                rest.append(p)
                raw.append(b)
        i = 0
        while i < len(rest):
            j, n = i, 0
            while j < len(rest) and j - i < SQL_PIECES and (j == i or n + len(raw[j]) ** 2 <= SQL_SQUARES):
                n += len(raw[j]) ** 2
                j += 1
            self._contract(rest[i:j], raw[i:j])
            i = j

    def _rows(self, raw: list[bytes]) -> dict:
        """Token rows of single bytes: key, tok and after (-1 at a piece's end)."""
        size = np.array([len(b) for b in raw])
        end = np.cumsum(size)
        tok = self.one[np.frombuffer(b"".join(raw), np.uint8)]
        after = np.append(tok[1:], np.int32(-1))
        after[end - 1] = -1
        return {"key": np.repeat(np.arange(len(raw)) * 1024 - end + size, size) + np.arange(len(tok)), "tok": tok, "after": after}

    def _contract(self, rest: list[str], raw: list[bytes]) -> None:
        """Encodes pieces by the recursive query."""
        self.db.register("token_rows", pa.table(self._rows(raw)))
        got = self.db.sql(_ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("token_rows")
        ids = got["ids"].combine_chunks()
        flat, at = ids.flatten().to_numpy().astype(np.int32), ids.offsets.to_numpy()
        for i, w in enumerate(got["word"].to_pylist()):
            self.cache[rest[w]] = flat[at[i] : at[i + 1]].tobytes()

    def _contract_long(self, raw: bytes) -> bytes:
        """Encodes one piece of any length, round by round."""
        self.db.execute(f"SET memory_limit = '{max(MEMORY, MEMORY_BYTE * len(raw))}B'")
        self.db.register("token_rows", pa.table(self._rows([raw])))
        # only merges whose token occurs in the piece can ever happen
        self.db.execute("CREATE OR REPLACE TABLE near_ids AS SELECT id, early, twice FROM vocabulary WHERE contains(?::VARCHAR, chars)", [raw.decode("latin-1")])
        self.db.execute("CREATE OR REPLACE TABLE near AS SELECT m.* FROM merges m SEMI JOIN near_ids ON id = rank")
        self.db.execute(f"CREATE OR REPLACE TABLE long_piece AS SELECT key AS i, tok, coalesce(rank, {_NO}) AS rank FROM token_rows t LEFT JOIN near m ON m.l = t.tok AND m.r = t.after")
        self.db.unregister("token_rows")
        while True:
            rank, least = self.db.execute("SELECT min(rank), arg_min(i, (rank, i)) FROM long_piece").fetchone()
            if rank == _NO:
                break
            self.db.execute(_ROUND, {"reach": self.reach, "least": least})
        out = self.db.execute("SELECT tok FROM long_piece ORDER BY i").fetchnumpy()["tok"].astype(np.int32).tobytes()
        for name in ("long_piece", "near", "near_ids"):
            self.db.execute(f"DROP TABLE {name}")
        self.db.execute(f"SET memory_limit = '{MEMORY}B'")
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        split = [self.find(t) for t in texts]
        known = self.cache
        if len(known) > CACHE:
            known.turn()
        self.learn(sorted(known.unknown(set(chain.from_iterable(split)))))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def decode(self, ids: list[bytes]) -> list[bytes]:
        """The bytes of each id array."""
        size = np.array([len(b) // 4 for b in ids], np.int64)
        out = [b""] * len(ids)
        if not size.sum():
            return out
        flat = np.frombuffer(b"".join(ids), np.int32)
        if flat.min() < 0 or int(flat.max()) >= len(self.ranks):
            raise ValueError("an id is not in the vocabulary")
        self.db.register("tokens", pa.table({"doc": np.repeat(np.arange(len(ids), dtype=np.int32), size), "pos": np.arange(len(flat), dtype=np.int32), "id": flat}))
        got = self.db.sql(_DECODE).to_arrow_table()
        self.db.unregister("tokens")
        for d, chars in zip(got["doc"].to_pylist(), got["chars"].to_pylist(), strict=True):
            out[d] = chars.encode("latin-1")
        return out

    def decode_all(self, ids: list[bytes]) -> list[bytes]:
        """decode() in rounds of about SQL_BYTES; a long document is spread over several, as its bytes concatenate."""
        out: list[list[bytes]] = [[] for _ in ids]
        held: list[tuple[int, bytes]] = []
        room = SQL_BYTES

        def flush() -> None:
            for (d, _), b in zip(held, self.decode([b for _, b in held]), strict=True):
                out[d].append(b)
            held.clear()

        for d, b in enumerate(ids):
            at, cost = 0, np.concatenate(([0], np.cumsum(self.cost.take(np.frombuffer(b, np.int32), mode="clip"))))
            while at + 1 < len(cost):
                end = int(np.searchsorted(cost, cost[at] + room, "right")) - 1
                if end == at and held:
                    flush()
                    room = SQL_BYTES
                    continue
                end = max(end, at + 1)
                held.append((d, b[4 * at : 4 * end]))
                room, at = max(0, room - int(cost[end] - cost[at])), end
        flush()
        return [b"".join(x) for x in out]


def _forget() -> None:
    _codecs.clear()


def codec(path: str, pattern: str) -> Codec:
    """The codec of a rank file, one for each worker."""
    if (path, pattern) not in _codecs:
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _codecs[path, pattern] = Codec(ranks, pattern)
    return _codecs[path, pattern]


def _blocks(sizes: list[int]):
    """Runs of documents of BLOCK_BYTES together, or of one."""
    i = 0
    while i < len(sizes):
        j, n = i, 0
        while j < len(sizes) and (j == i or n + sizes[j] <= BLOCK_BYTES):
            n += sizes[j]
            j += 1
        yield i, j
        i = j


def encode_decode(df: DataFrame, text: str, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df without its text and with the columns ids (binary: unsigned 32-bit integers, little-endian) and decoded (the bytes that those ids stand for).

    The vocabulary file must be where path says on every machine, as installed packages are.
    """
    keep = [c for c in df.columns if c not in (text, ids, decoded)]

    def run(batches):
        with cached("byte_bpe", _forget):
            c = codec(path, pattern)
            for batch in batches:
                column = batch.column(len(keep))
                for i, j in _blocks(pc.fill_null(pc.binary_length(column), 0).to_pylist()):
                    enc = c.encode([t or "" for t in column.slice(i, j - i).to_pylist()])
                    dec = c.decode_all(enc)
                    yield pa.RecordBatch.from_arrays([batch.column(k).slice(i, j - i) for k in range(len(keep))] + [pa.array(enc, pa.binary()), pa.array(dec, pa.binary())], names=[*keep, ids, decoded])

    src = df.select(*[df[f"`{c}`"] for c in keep], df[f"`{text}`"])
    schema = T.StructType([df.schema[c] for c in keep] + [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.BinaryType())])
    return src.mapInArrow(run, schema)
