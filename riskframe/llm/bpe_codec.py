"""BPE encoding and decoding by dynamic programming over prefixes.

The BPE encoding of every prefix of a byte string ends in one token only.  For
each prefix the tokens that end there are found by walking an automaton of the
reversed vocabulary, and the one that is compatible with the last token of the
prefix before it is stored; back-pointers from the end then give the exact
ids.  Two tokens are compatible if undoing their merges, latest first, never
meets a merge across the seam that BPE would have made earlier.

Texts are first cut as the tokenizer file says: at special tokens, then into
pieces by its pattern.  Pieces recur, so each worker keeps a bounded cache of
encoded stretches.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskframe.llm.token_counts import by_bytes, can_split, segments, worker_state

#: The published byte-level pattern of this tokenizer family.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_ENTRIES, GROUP_CHARS, MARKS = 400_000, 1 << 20, frozenset(".,;:!?")


def byte_symbols() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the code points from 256 on, in byte order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {chr(b): b for b in plain}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


class Codec:
    """Exact encoder and decoder for a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            raw = f.read()
        conf = json.loads(raw)
        model, symbols = conf["model"], byte_symbols()
        if conf.get("normalizer") is not None or not can_split(raw):
            raise ValueError("only byte-level BPE without a normalizer is supported")
        to_bytes = lambda s: bytes(symbols[c] for c in s)
        special = {t["content"]: t["id"] for t in conf.get("added_tokens", ())}
        self.special = special
        self.vocab = {to_bytes(t): i for t, i in model["vocab"].items() if t not in special}
        self.bytes_of = {i: b for b, i in self.vocab.items()}
        self.bytes_of.update({i: s.encode() for s, i in special.items()})
        self.longest = max(map(len, self.vocab))
        # merge order: single bytes first, then each merge in file order
        self.order: dict[int, int] = {self.vocab[bytes([b])]: -1 for b in range(256) if bytes([b]) in self.vocab}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for rank, m in enumerate(model["merges"]):
            left, right = (to_bytes(x) for x in (m.split(" ") if isinstance(m, str) else m))
            a, b, ab = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.merged[(a, b)] = rank
            if ab not in self.order:
                self.order[ab], self.parts[ab] = rank, (a, b)
        self.trie = self._reversed_automaton()
        self.pair_ok: dict[tuple[int, int], bool] = {}
        self.alone: dict[int, bool] = {}

    def _reversed_automaton(self):
        """States of the reversed vocabulary: byte -> next state, -1 -> token."""
        root: dict = {}
        for token, i in self.vocab.items():
            state = root
            for b in reversed(token):
                state = state.setdefault(b, {})
            state[-1] = i
        return root

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE of the two tokens' bytes gives exactly these tokens.

        A merge across the seam is made if it comes before the later of the
        merges that built its two sides' seam tokens, so those are undone
        latest first, each undone merge bounding the merges still possible."""
        key = (a, b)
        known = self.pair_ok.get(key)
        if known is not None:
            return known
        order, parts, merged = self.order, self.parts, self.merged
        limit, ok = 1 << 40, True
        while True:
            rank = merged.get((a, b))
            if rank is not None and rank < limit:
                ok = False
                break
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                break
            if ra > rb:
                limit, a = min(limit, ra), parts[a][1]
            else:
                # at equal ranks the left occurrence merges first: the seam may still take the right's own rank
                limit, b = min(limit, rb + 1), parts[b][0]
        if len(self.pair_ok) > 400_000:
            self.pair_ok.clear()
        self.pair_ok[key] = ok
        return ok

    def encode_piece(self, data: bytes) -> list[int]:
        """Ids of one pattern piece."""
        last: list[int] = [-1] * (len(data) + 1)
        start: list[int] = [0] * (len(data) + 1)
        trie, compatible, pair_ok = self.trie, self.compatible, self.pair_ok
        for end in range(1, len(data) + 1):
            state, at, found = trie, end, -1
            while at > 0:
                state = state.get(data[at - 1])
                if state is None:
                    break
                at -= 1
                token = state.get(-1)
                if token is None:
                    continue
                # the valid last token is unique: the first that fits the prefix before it
                fits = pair_ok.get((last[at], token)) if at else self.whole(token)
                if fits is None:
                    fits = compatible(last[at], token)
                if fits:
                    found, start[end] = token, at
                    break
            last[end] = found
        ids, end = [], len(data)
        while end:
            ids.append(last[end])
            end = start[end]
        ids.reverse()
        return ids

    def whole(self, token: int) -> bool:
        """Whether BPE of the token's own bytes is the token alone."""
        known = self.alone.get(token)
        if known is None:
            parts = self.parts.get(token)
            known = self.alone[token] = parts is None or self._compatible_below(*parts, self.order[token])
        return known

    def _compatible_below(self, a: int, b: int, rank: int) -> bool:
        """As ``compatible``, leaving aside the merge of ``rank`` itself."""
        order, parts, merged = self.order, self.parts, self.merged
        limit = rank
        while True:
            r = merged.get((a, b))
            if r is not None and r < limit and r != rank:
                return False
            ra, rb = order[a], order[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = min(limit, ra), parts[a][1]
            else:
                limit, b = min(limit, rb + 1), parts[b][0]

    def decode(self, ids: list[int]) -> str:
        """Text of the ids; bytes that are no UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


class CachedCodec:
    """A codec that remembers encoded stretches of text between safe spaces."""

    def __init__(self, path: str):
        import regex
        self.codec = Codec(path)
        self.pieces = regex.compile(PATTERN).findall
        names = sorted(self.codec.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, names)) + ")").split if names else None
        self.cache: dict[str, tuple[int, ...]] = {}

    def _ids(self, stretch: str) -> tuple[int, ...]:
        marked = any(name in stretch for name in self.codec.special)
        parts = self.cut(stretch) if marked else [stretch]
        ids: list[int] = []
        for k, part in enumerate(parts):
            if k % 2:
                ids.append(self.codec.special[part])
            else:
                for piece in self.pieces(part):
                    ids += self.codec.encode_piece(piece.encode("utf-8", "surrogatepass"))
        return tuple(ids)

    def _after_space(self, seg: str) -> tuple[int, ...]:
        """Ids of ``' ' + seg``.  A run of letters is one piece of the pattern,
        and so is one mark after it; the pattern decides all other cases."""
        if seg.isalpha():
            return tuple(self.codec.encode_piece((" " + seg).encode()))
        core, mark = seg[:-1], seg[-1:]
        if mark in MARKS and core.isalpha():
            got = self.cache.get(core)
            if got is None:
                got = self.cache[core] = self._after_space(core)
            return got + (self.codec.vocab[mark.encode()],)
        return self._ids(" " + seg)

    def encode(self, text: str) -> list[int]:
        """Ids of ``text``.  The cache is keyed by stretch without its leading
        space; the first stretch of a text, which has none, is not cached."""
        cache = self.cache
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        head, *rest = segments(text)
        ids = list(self._ids(head))
        for seg in rest:
            got = cache.get(seg)
            if got is None:
                got = self._after_space(seg)
                if len(seg) <= 64:
                    cache[seg] = got
            ids += got
        return ids


def encode_decode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  with_ids: bool = False) -> DataFrame:
    """``<id>, n_tokens, ids_sha256, decoded_sha256`` per row of ``docs``, and
    with ``with_ids`` the ids and the decoded text themselves.

    Ids equal the tokenizer library's without added special tokens; special
    strings inside texts become their token.  NULL texts are empty, repeated
    rows are encoded each, other columns are ignored.  No shuffle."""
    idtype = dict(docs.dtypes)[id_col]
    schema = f"`{id_col}` {idtype}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codec = worker_state("codec", tokenizer_path, lambda: CachedCodec(tokenizer_path))
        names: dict[int, str] = {i: str(i) for i in codec.codec.bytes_of}
        for frame in batches:
            texts = ["" if t is None else t for t in frame["t"]]
            rows = []
            for group in by_bytes(texts, GROUP_CHARS):
                for t in group:
                    ids = codec.encode(t)
                    text = codec.codec.decode(ids)
                    row = (len(ids), hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest(),
                           hashlib.sha256(text.encode("utf-8", "replace")).hexdigest())
                    rows.append(row + ((ids, text) if with_ids else ()))
            cols = ["n_tokens", "ids_sha256", "decoded_sha256"] + (["ids", "decoded"] if with_ids else [])
            out = pd.DataFrame(rows, columns=cols)
            out.insert(0, id_col, frame["i"].to_numpy())
            yield out

    return docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).mapInPandas(run, schema)
