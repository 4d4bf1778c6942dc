"""Byte-level BPE encoding and decoding by ranks (operator 7).

Every text is split by the GPT-2 style pattern, each piece is merged on its own,
always at the leftmost pair of least rank.  Per piece a segment tree over its
byte positions keeps, in every node, the smallest ``rank << 32 | position`` below
it, so the root is the leftmost minimum; a merge is three point updates (the
merged position, its live left neighbour, and the position that dies), each
logarithmic in the piece's length.  Pieces of up to ``WIDE`` bytes are merged
side by side as rows of one numpy tree; longer ones use the same tree one by one.

Spark deals the texts; a task splits about a million characters at a time with
array operations, merges each *distinct* piece of them once, and keeps a bounded
cache of pieces.  Decoding joins the bytes of the ids and is compared with the
text, which also proves that no two pieces were taken for one another.

Cases: a null text counts as empty and gives no ids; repeated rows and ids give
one result each; unknown bytes can't occur (all 256 bytes must have a rank, else
``ValueError``); an empty table gives an empty table; only the two named columns
are read, so other columns of any name do no harm.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from codeweave.llm.common import chunks, code_points

WIDE = 64  # longest piece, in bytes, that is merged in a numpy row
ROWS = 4_000  # pieces merged side by side
CACHE_PIECES = 800_000
CHUNK_CHARS = 1_000_000
NONE = np.int64(2**62)
MASK32 = (1 << 32) - 1
LETTER, NUMBER, SPACE, OTHER = range(4)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _classes() -> np.ndarray:
    """Class of every code point: letter, number, white space (Unicode's property) or other."""
    out = np.full(0x110000, OTHER, np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            out[i] = LETTER
        elif k == "N":
            out[i] = NUMBER
        elif k == "Z":  # Zs, Zl and Zp are all white space
            out[i] = SPACE
    out[[9, 10, 11, 12, 13, 0x85]] = SPACE
    return out


def read_ranks(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


class Codec:
    """Ranks, pair table and piece cache of one worker."""

    def __init__(self, rank_file: bytes) -> None:
        pairs = (line.split() for line in rank_file.splitlines() if line.strip())
        self.ranks = {base64.b64decode(a): int(b) for a, b in pairs}
        if len({bytes([i]) for i in range(256)} - self.ranks.keys()):
            raise ValueError("the rank file must hold all 256 single bytes")
        n = max(self.ranks.values()) + 1
        self.bytes_of = [b""] * n
        keys, vals = [], []
        for tok, r in self.ranks.items():
            self.bytes_of[r] = tok
            for i in range(1, len(tok)):
                a, b = self.ranks.get(tok[:i]), self.ranks.get(tok[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    vals.append(r)
        order = np.argsort(np.array(keys, np.int64))
        self.keys, self.vals = np.array(keys, np.int64)[order], np.array(vals, np.int64)[order]
        self.pair = dict(zip(keys, vals))
        self.byte_id = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        self.tok_len = np.array([len(x) for x in self.bytes_of], np.int64)
        self.tok_at = np.concatenate([[0], np.cumsum(self.tok_len)])
        self.tok_bytes = np.frombuffer(b"".join(self.bytes_of), np.uint8)
        self.cls = _classes()
        self._powers(CHUNK_CHARS + 1)
        self.forget()

    def forget(self) -> None:
        """Empty the piece cache: hash of a piece -> its place in the pool of ids."""
        self.slot: dict[int, int] = {}
        self.pool = np.empty(1 << 16, np.uint32)
        self.pool_n = 0
        self.at = np.empty(1 << 16, np.int64)
        self.cnt = np.empty(1 << 16, np.int64)

    # ------------------------------------------------------------- merging
    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a << np.int64(32) | b
        i = np.searchsorted(self.keys, key)
        i[i == len(self.keys)] = 0
        return np.where(self.keys[i] == key, self.vals[i], NONE >> 32)

    def merge_rows(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Merge many short pieces at once: row r of the tree is the tree of piece r."""
        n, longest = len(pieces), max(map(len, pieces))
        width = 1 << max(1, (longest - 1).bit_length())
        lens = np.array([len(p) for p in pieces])
        raw = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in pieces), np.uint8).reshape(n, width)
        ids = self.byte_id[raw]
        pos = np.arange(width)
        nxt = np.broadcast_to(pos + 1, (n, width)).copy()
        prv = np.broadcast_to(pos - 1, (n, width)).copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        live = pos[None, :-1] + 1 < lens[:, None]
        r = self._rank_of(ids[:, :-1], ids[:, 1:])
        tree[:, width:2 * width - 1] = np.where(live, r << 32 | pos[:-1], NONE)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[:, 2 * i], tree[:, 2 * i + 1], out=tree[:, i])
        dead = pos[None, :] >= lens[:, None]
        flat, fid, fnxt, fprv = tree.reshape(-1), ids.reshape(-1), nxt.reshape(-1), prv.reshape(-1)
        fdead = dead.reshape(-1)
        rows = np.nonzero(tree[:, 1] < NONE)[0]
        while len(rows):
            top = flat[rows * (2 * width) + 1]
            p = top & MASK32
            at = rows * width  # first position of the row
            q = fnxt[at + p]
            after, before = fnxt[at + q], fprv[at + p]
            fid[at + p] = top >> 32
            fdead[at + q] = True
            fnxt[at + p] = after
            has = np.nonzero(after < lens[rows])[0]
            left = np.nonzero(before >= 0)[0]
            fprv[(at + after)[has]] = p[has]
            # pairs that changed: the merged position with its next, its previous with it
            first = np.concatenate([(at + p)[has], (at + before)[left]])
            second = np.concatenate([(at + after)[has], (at + p)[left]])
            r = self._rank_of(fid[first], fid[second])
            where = np.concatenate([p[has], before[left]])
            value = np.where(r < NONE >> 32, r << 32 | where, NONE)
            root = np.concatenate([rows, rows, rows[has], rows[left]]) * (2 * width)
            node = np.concatenate([p, q, where]) + width
            flat[(root[:2 * len(rows)] + node[:2 * len(rows)])] = NONE
            flat[root[2 * len(rows):] + node[2 * len(rows):]] = value
            for _ in range(width.bit_length() - 1):  # point updates, one level at a time
                node >>= 1
                i = root + 2 * node
                flat[root + node] = np.minimum(flat[i], flat[i + 1])
            rows = rows[flat[rows * (2 * width) + 1] < NONE]
        return [ids[i][~dead[i]] for i in range(n)]

    def merge_long(self, piece: bytes) -> np.ndarray:
        """The same tree for one long piece, with Python integers."""
        n = len(piece)
        width = 1 << (n - 1).bit_length()
        ids = [int(self.byte_id[b]) for b in piece]
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        none, pair = int(NONE), self.pair
        tree = [none] * (2 * width)

        def value(a: int) -> int:
            b = nxt[a]
            r = pair.get(ids[a] << 32 | ids[b]) if b < n else None
            return none if r is None else r << 32 | a

        def put(at: int, v: int) -> None:
            i = at + width
            tree[i] = v
            i >>= 1
            while i:
                x, y = tree[2 * i], tree[2 * i + 1]
                v = x if x < y else y
                if tree[i] == v:
                    return
                tree[i] = v
                i >>= 1

        for i in range(n - 1):
            tree[width + i] = value(i)
        for i in range(width - 1, 0, -1):
            tree[i] = min(tree[2 * i], tree[2 * i + 1])
        gone = bytearray(n)
        while tree[1] < none:
            top = tree[1]
            p = top & MASK32
            q = nxt[p]
            ids[p] = top >> 32
            gone[q] = 1
            nxt[p] = nxt[q]
            if nxt[q] < n:
                prv[nxt[q]] = p
            put(p, value(p))
            put(q, none)
            if prv[p] >= 0:
                put(prv[p], value(prv[p]))
        return np.array([x for x, g in zip(ids, gone) if not g], np.int64)

    def merge(self, pieces: list[bytes]) -> list[np.ndarray]:
        """Ids of each piece; a piece that has a rank of its own is one id."""
        out: list = [None] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            whole = self.ranks.get(p)
            if whole is not None:
                out[i] = np.array([whole])
            elif len(p) > WIDE:
                out[i] = self.merge_long(p)
            else:
                by_width.setdefault((len(p) - 1).bit_length(), []).append(i)
        for where in by_width.values():
            for k in range(0, len(where), ROWS):
                part = where[k:k + ROWS]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part])):
                    out[i] = ids
        return out

    # ----------------------------------------------------------- splitting
    def starts(self, cp: np.ndarray, text_start: np.ndarray) -> np.ndarray:
        """Flags of the first code point of each piece; ``text_start`` flags the first of each text."""
        n = len(cp)
        c = self.cls[cp]
        st = text_start.copy()
        st[0] = True
        st[1:] |= c[1:] != c[:-1]
        inside = ~text_start[1:]  # i and i + 1 are of one text
        last = np.nonzero((c[:-1] == SPACE) & (c[1:] != SPACE) & inside)[0]
        st[last] = True  # the last blank of a run, before something else, stands alone
        joined = last[cp[last] == 32] + 1
        st[joined] = False  # or leads the next piece if it is a plain space
        quote = np.nonzero(st & (cp == 39))[0]
        if len(quote):
            pad = np.concatenate([cp, np.zeros(3, np.uint32)])
            new = np.concatenate([text_start, np.ones(3, bool)])
            a, b = pad[quote + 1], pad[quote + 2]
            one = np.isin(a, [ord(x) for x in "stmd"]) & ~new[quote + 1]
            two = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) \
                & ~new[quote + 1] & ~new[quote + 2]
            st[quote[one | two] + 1] = False
            after = np.concatenate([quote[one] + 2, quote[two] + 3])
            st[after[after < n]] = True
        return st

    def _powers(self, n: int) -> None:
        self.pow = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, _BASE, np.uint64))])
        inv = np.uint64(pow(int(_BASE), -1, 2**64))
        self.inv = np.concatenate([[np.uint64(1)], np.cumprod(np.full(n, inv, np.uint64))])

    def _hashes(self, cp: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        if len(cp) >= len(self.pow):
            self._powers(len(cp) + 1)
        v = (cp.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)
        v ^= v >> np.uint64(29)
        v *= self.pow[:len(cp)]
        total = np.concatenate([[np.uint64(0)], np.cumsum(v, dtype=np.uint64)])
        h = (total[e] - total[s]) * self.inv[s]
        h ^= (e - s).astype(np.uint64) * np.uint64(0xA0761D6478BD642F)
        h ^= h >> np.uint64(31)
        return h * np.uint64(0x8EBC6AF09C88C6E3)

    # ---------------------------------------------------------------- texts
    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text."""
        out: list = []
        for _, part in chunks(texts, CHUNK_CHARS):
            out += self._encode_part(part)
        return out

    def _encode_part(self, texts: list[str]) -> list[np.ndarray]:
        empty = np.empty(0, np.uint32)
        joined = "".join(texts)
        if not joined:
            return [empty] * len(texts)
        cp = code_points(joined)
        lens = np.array([len(t) for t in texts])
        ends = np.cumsum(lens)
        text_start = np.zeros(len(cp), bool)
        text_start[(ends - lens)[lens > 0]] = True
        s = np.nonzero(self.starts(cp, text_start))[0]
        e = np.append(s[1:], len(cp))
        uniq, first, inverse = np.unique(self._hashes(cp, s, e), return_index=True, return_inverse=True)
        if len(self.slot) + len(uniq) > max(CACHE_PIECES, len(uniq)):
            self.forget()
        keys = uniq.tolist()
        got = [self.slot.get(k, -1) for k in keys]
        miss = [i for i, g in enumerate(got) if g < 0]
        if miss:
            pieces = [joined[s[j]:e[j]].encode("utf-8", "replace") for j in first[miss].tolist()]
            for i, ids in zip(miss, self.merge(pieces)):
                got[i] = self._keep(keys[i], ids)
        slot = np.array(got)[inverse]
        cnt, at = self.cnt[slot], self.at[slot]
        upto = np.concatenate([[0], np.cumsum(cnt)])
        ids = self.pool[np.repeat(at - upto[:-1], cnt) + np.arange(upto[-1])]
        cut = upto[np.searchsorted(s, ends)]  # ids before the end of each text
        out = [ids[a:b] for a, b in zip(np.concatenate([[0], cut[:-1]]), cut)]
        if self._decode_flat(ids) != joined.encode("utf-8", "replace"):  # two pieces with one hash
            out = [np.concatenate([empty, *self.merge(self.pieces(t))]).astype(np.uint32) for t in texts]
        return out

    def pieces(self, text: str) -> list[bytes]:
        if not text:
            return []
        cp = code_points(text)
        first = np.zeros(len(cp), bool)
        s = np.nonzero(self.starts(cp, first))[0].tolist()
        return [text[a:b].encode("utf-8", "replace") for a, b in zip(s, [*s[1:], len(text)])]

    def _keep(self, key: int, ids: np.ndarray) -> int:
        k, n = len(self.slot), len(ids)
        while self.pool_n + n > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty_like(self.pool)])
        if k == len(self.at):
            self.at, self.cnt = (np.concatenate([x, np.empty_like(x)]) for x in (self.at, self.cnt))
        self.pool[self.pool_n:self.pool_n + n] = ids
        self.at[k], self.cnt[k] = self.pool_n, n
        self.pool_n += n
        self.slot[key] = k
        return k

    def _decode_flat(self, ids: np.ndarray) -> bytes:
        ids = ids.astype(np.int64)
        n = self.tok_len[ids]
        upto = np.concatenate([[0], np.cumsum(n)])
        return self.tok_bytes[np.repeat(self.tok_at[ids] - upto[:-1], n) + np.arange(upto[-1])].tobytes()

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of the ids; an id without a token raises IndexError."""
        return self._decode_flat(np.asarray(ids))


_CODECS: dict[int, Codec] = {}


def codec(rank_file: bytes) -> Codec:
    """One codec per worker process and rank file."""
    key = hash(rank_file)
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(rank_file)
    return _CODECS[key]


def encode_texts(docs: DataFrame, rank_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id_col, ids, decoded)``: ids as little-endian unsigned 32-bit integers, decoded their bytes.

    The rank file (a bounded vocabulary, under 1 MB) is read on the driver and broadcast.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            for at, part in chunks(texts, 4 * CHUNK_CHARS):
                ids = c.encode(part)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(part)),
                     pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()),
                     pa.array([c.decode(x) for x in ids], pa.binary())], names=[id_col, "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids binary, decoded binary")


def decode_ids(encoded: DataFrame, rank_path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(id_col, decoded)`` of a table of ids as ``encode_texts`` writes them; null ids give empty bytes."""
    ranks = encoded.sparkSession.sparkContext.broadcast(read_ranks(rank_path))
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(ranks.value)
        for b in batches:
            out = [c.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], names=[id_col, "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"`{id_col}` {kind}, decoded binary")
