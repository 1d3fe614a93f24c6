"""Byte-level BPE: exact encoding by backtracking over longest matches, decoding by an offset table."""

from __future__ import annotations

import array
import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The split pattern and the byte alphabet of the vocabulary's file format.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTABLE = [(33, 126), (161, 172), (174, 255)]
#: Pieces remembered per task, and the longest of them in characters; a full memory is cleared, and
#: longer ones are computed again, which changes no result.
MEMORY, LONGEST = 200_000, 64


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """Character of the file -> byte: printable bytes are themselves, the others follow from 256 on."""
    own = [b for lo, hi in PRINTABLE for b in range(lo, hi + 1)]
    table = {chr(b): b for b in own}
    table.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(own))})
    return table


class _Memory(dict):
    """Computes what it lacks; cleared when full."""

    def __init__(self, compute):
        self.compute = compute

    def __missing__(self, key):
        value = self.compute(key)
        if not isinstance(key, str) or len(key) <= LONGEST:
            if len(self) >= MEMORY:
                self.clear()
            self[key] = value
        return value


class Codec:
    """Encoder and decoder of one vocabulary file (JSON, byte-level BPE)."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        alphabet = byte_alphabet()
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in merges]
        # Tokens as latin-1 text, one character per byte.
        raw = {t: "".join(chr(alphabet[c]) for c in t) for t in vocab}
        size = max([*vocab.values(), *(a["id"] for a in spec["added_tokens"])]) + 1
        self.length = [0] * size
        self.rank, self.left, self.right = [0] * size, [0] * size, [0] * size
        self.merge_rank: dict[tuple[int, int], int] = {}
        for place, (a, b) in enumerate(merges, 1):
            whole = vocab[a + b]
            self.merge_rank[vocab[a], vocab[b]] = place
            if not self.rank[whole]:
                self.rank[whole], self.left[whole], self.right[whole] = place, vocab[a], vocab[b]
        self.matches = ahocorasick.Automaton()
        for t, i in vocab.items():
            # A token that no merge makes is never a result, unless it is a byte.
            if self.rank[i] or len(raw[t]) == 1:
                self.length[i] = len(raw[t])
                self.matches.add_word(raw[t], i)
        self.matches.make_automaton()
        # The longest other token that starts each token.
        known = {raw[t]: i for t, i in vocab.items() if self.length[i]}
        self.shorter = [-1] * size
        for text, i in known.items():
            for cut in range(len(text) - 1, 0, -1):
                if text[:cut] in known:
                    self.shorter[i] = known[text[:cut]]
                    break
        self.allowed: dict[tuple[int, int], bool] = {}
        self.added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        self._added = re.compile("|".join(re.escape(t) for t in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._split = regex.compile(SPLIT)
        self._pieces: dict[str, bytes] = {}
        self._parts = _Memory(self._part)
        # Decoding: token i is bytes[offset[i]:offset[i + 1]].
        of = {i: raw[t].encode("latin-1") for t, i in vocab.items()} | {i: t.encode() for t, i in self.added.items()}
        sizes = [len(of.get(i, b"")) for i in range(size)]
        self.offset = np.concatenate([[0], np.cumsum(sizes)])
        self.bytes = np.frombuffer(b"".join(of.get(i, b"") for i in range(size)), np.uint8)

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` side by side: undoing their merges from the
        newest on, no pair across the border may have merged before its parts grew."""
        key = (a, b)
        known = self.allowed.get(key)
        if known is not None:
            return known
        rank, merge_rank = self.rank, self.merge_rank
        before = 1 << 60
        answer = True
        while True:
            if merge_rank.get((a, b), 1 << 60) < before:
                answer = False
                break
            if not rank[a] and not rank[b]:
                break
            if rank[a] > rank[b]:
                before, a = rank[a], self.right[a]
            else:
                # Of equal pairs the left one merges first, so an equal rank counts too.
                before, b = rank[b] + 1, self.left[b]
        if len(self.allowed) > 4 * MEMORY:
            self.allowed.clear()
        self.allowed[key] = answer
        return answer

    def piece(self, text: bytes) -> list[int]:
        """Ids of one piece: take the longest match, fall back to shorter ones and to earlier places."""
        n, length, shorter = len(text), self.length, self.shorter
        longest = [-1] * n
        for end, token in self.matches.iter(text.decode("latin-1")):
            start = end + 1 - length[token]
            if longest[start] < 0 or length[longest[start]] < length[token]:
                longest[start] = token
        out: list[int] = []
        dead = bytearray(n + 1)
        at, token = 0, longest[0] if n else -1
        while at < n:
            end = at + length[token]
            if not dead[end] and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                token = longest[at] if at < n else -1
            elif shorter[token] >= 0:
                token = shorter[token]
            else:
                # Nothing fits here: this place is never reached again, try a shorter token before it.
                dead[at] = 1
                token = out.pop()
                at -= length[token]
        return out

    def _ids(self, piece: str) -> bytes:
        """Ids of one piece of the split pattern, remembered."""
        found = self._pieces.get(piece)
        if found is None:
            text = piece.encode()
            # The longest matches from the left on are the answer where all neighbours are
            # compatible; otherwise search on from there.
            ids = [token for _, token in self.matches.iter_long(text.decode("latin-1"))]
            allowed, last = self.allowed, -1
            for token in ids:
                if last >= 0 and not (allowed.get((last, token)) or self.compatible(last, token)):
                    ids = self.piece(text)
                    break
                last = token
            found = array.array("I", ids).tobytes()
            if len(piece) <= LONGEST:
                if len(self._pieces) >= MEMORY:
                    self._pieces.clear()
                self._pieces[piece] = found
        return found

    def _part(self, text: str) -> bytes:
        m = self._simple.fullmatch(text)
        if m:
            letters, marks = m.groups()
            return self._ids(letters) + self._ids(marks) if marks else self._ids(letters)
        return b"".join([self._ids(p) for p in self._split.findall(text)])

    def _plain(self, text: str) -> bytes:
        """A blank or a line end between two other marks always starts a piece (the line end also
        ends it), so texts without other white space are cut there and the parts remembered."""
        if self._odd.search(text):
            return b"".join([self._ids(p) for p in self._split.findall(text)])
        return b"".join(map(self._parts.__getitem__, text.replace("\n", "\0\n\0").replace(" ", "\0 ").split("\0")))

    # Letters, then marks that start no contraction: two pieces at most.
    _simple = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")
    # White space next to white space or at an end, and any but blank and line end.
    _odd = re.compile(r"\s\s|^\s|\s\Z|[^\S \n]|[\0\x1c-\x1f\x85]")

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text; texts of added tokens are their ids."""
        if not text:
            return np.zeros(0, "<u4")
        out: list[bytes] = []
        at = 0
        for m in self._added.finditer(text) if self._added else ():
            if m.start() > at:
                out.append(self._plain(text[at : m.start()]))
            out.append(np.array([self.added[m[0]]], "<u4").tobytes())
            at = m.end()
        if at < len(text):
            out.append(self._plain(text[at:] if at else text))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; bytes that are no UTF-8 become replacement marks."""
        parts = []
        for s in range(0, len(ids), 1 << 18):
            i = ids[s : s + (1 << 18)].astype(np.int64)
            starts, sizes = self.offset[i], self.offset[i + 1] - self.offset[i]
            ends = np.cumsum(sizes)
            parts.append(self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - sizes), sizes)].tobytes())
        whole = b"".join(parts)
        try:
            whole.decode()
            return whole
        except UnicodeDecodeError:
            return whole.decode("utf-8", "replace").encode()


def round_trip(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Per document its number of ids and the SHA-256 of the ids and of the decoded text.
    A null text is empty; repeated rows and ids stay rows of their own."""
    path = path or vocabulary_path()
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def coded(batches):
        codec = Codec(path)
        for batch in batches:
            counts, ids_sha, text_sha = [], [], []
            for text in batch.column("text"):
                ids = codec.encode(text.as_py() or "")
                counts.append(len(ids))
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                text_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_sha), pa.array(text_sha)],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select("doc_id", "text").mapInArrow(coded, f"doc_id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """``docs`` with ids array<int> and decoded (text): the operator's real outputs."""
    path = path or vocabulary_path()
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in ("ids", "decoded")])
    schema = T.StructType([*kept.schema.fields]).add("ids", T.ArrayType(T.IntegerType())).add("decoded", "string")

    def coded(batches):
        codec = Codec(path)
        for batch in batches:
            ids = [codec.encode(t.as_py() or "") for t in batch.column(batch.schema.get_field_index("text"))]
            decoded = [codec.decode(i).decode() for i in ids]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32())), pa.array(decoded, pa.string())],
                [*batch.schema.names, "ids", "decoded"],
            )

    return kept.mapInArrow(coded, schema)


def op7(docs: DataFrame) -> DataFrame:
    return round_trip(docs)
