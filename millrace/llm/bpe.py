"""BPE encoding and decoding with content-defined chunk reuse.

A text is cut where a rolling hash of its last bytes says so, so equal passages give equal
chunks wherever they stand.  A task encodes each distinct chunk once and keeps it, for all
its documents.  A chunk is put together from units, white-space separated pieces that the
tokenizer can never merge across; each distinct unit is encoded by the tokenizer once.

A cut may fall inside a unit: what stands at a chunk's ends then is not encoded with it.
Joining two chunks encodes the unit across the join anew, from as many chunks as it takes
until white space ends it, so that the ids are those of the whole text.
"""

from __future__ import annotations

import hashlib
import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import ArrayType, IntegerType

from .common import per_batch, random64, slices, table

TOKENIZER = "word_bpe_49k.json"
#: Bytes that the rolling hash sees, and the mean distance of its cuts.
WINDOW, MEAN_CHUNK = 16, 512
#: Bounds of a task's memory, for each of two generations of units and chunks: what is in use moves to the newer one.
MAX_UNITS, MAX_CHUNK_BYTES = 400_000, 32 << 20
#: Longer units (texts without white space) are encoded each time.
MAX_UNIT_BYTES = 64

_LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+")
# ASCII without the apostrophe and capitals falls apart into letter runs, single digits and runs of the rest.
_ASCII = re.compile(rb"[!-&(-@\[-~]+")
_PIECES = re.compile(rb"[a-z]+|[0-9]|[!-&(-/:-`{-~]+")
# U+0300 to U+036F, the marks that NFC may join with a Latin letter: with a capital otherwise than with the small one.
_MARK = re.compile(rb"\xcc[\x80-\xbf]|\xcd[\x80-\xaf]")
# All settings of the tokenizer but its vocabulary, merges and special tokens, under which white
# space parts its tokens and units can be encoded by themselves.
FITS = {
    "truncation": None,
    "padding": None,
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "post_processor": None,
    "decoder": None,
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": "</w>", "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
_WHITE = b" \t\n\v\f\r"
_GEAR = random64(256, 5)


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def cut_points(data: np.ndarray, window: int = WINDOW, mean: int = MEAN_CHUNK) -> np.ndarray:
    """Places where the rolling hash of the ``window`` bytes before (a power of two, like ``mean``)
    is 0 modulo ``mean``."""
    if len(data) < window:
        return np.zeros(0, np.int64)
    h = _GEAR[data]
    step, factor = 1, 0x9E3779B97F4A7C15
    while step < window:
        h = h[:-step] * np.uint64(factor) + h[step:]
        factor = factor * factor % 2**64
        step *= 2
    return np.flatnonzero((h >> np.uint64(33)) & np.uint64(mean - 1) == 0) + window


class _Units(dict):
    """Unit (lower-cased bytes without white space) -> its ids as little-endian uint32.

    Two generations of at most ``MAX_UNITS`` each: what is still in use moves to the new one.
    """

    def __init__(self, tok, special: re.Pattern):
        from tokenizers.pre_tokenizers import ByteLevel

        super().__init__()
        self.tok, self.model, self.special, self.old = tok, tok.model, special, {}
        as_bytes = ByteLevel(add_prefix_space=False, use_regex=False)
        # Upper-case letters of Latin-1 fold to 32 above, as the tokenizer folds them.
        fold = {c: chr(c).lower() for c in range(0xC0, 0x100)}
        self.latin = {c: as_bytes.pre_tokenize_str(x)[0][0] for c, x in fold.items()}

    def _word(self, word: str) -> list[int]:
        return [t.id for t in self.model.tokenize(word)]

    def __missing__(self, unit: bytes) -> bytes:
        out = self.old.get(unit)
        if out is None:
            # Letters alone are one word to the tokenizer: its model takes them as they are.
            if unit.isalpha():
                ids = self._word(unit.decode())
            elif _LATIN.fullmatch(unit):
                ids = self._word(unit.decode().translate(self.latin))
            elif _ASCII.fullmatch(unit) and not self.special.search(unit):
                ids = [i for p in _PIECES.findall(unit) for i in self._word(p.decode())]
            else:
                ids = self.tok.encode(unit.decode(), add_special_tokens=False).ids
            out = packed(ids)
        if len(unit) <= MAX_UNIT_BYTES:
            self[unit] = out
        return out

    def trim(self) -> None:
        if len(self) > MAX_UNITS:
            self.old = dict(self)
            self.clear()


def packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder != "little":
        a.byteswap()
    return a.tobytes()


def _spaced(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes with a blank before each full stop or comma between a letter and white space
    (or the text's end), where the tokenizer parts them anyway; and where the blanks went."""
    n = len(data)
    at = np.flatnonzero((data == 46) | (data == 44))
    at = at[at > 1]
    ends = np.zeros(n + 1, bool)
    ends[offs] = True
    after = np.append(data, 32)[at + 1]
    closed = (after == 32) | ((after >= 9) & (after <= 13)) | ends[at + 1]
    one, two = data[at - 1], data[at - 2]
    letter = (one >= 97) & (one <= 122) | (two == 0xC3) & (one >= 0x80) & (one <= 0xBF) & (one != 0x97) & (one != 0xB7)
    at = at[closed & letter & ~ends[at]]
    return np.insert(data, at, 32), at


class Codec:
    """Encodes whole texts exactly as the tokenizer does; one for each Python worker."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        tok = Tokenizer.from_file(path)
        tok.no_padding()
        tok.no_truncation()
        parts = json.loads(tok.to_str())
        model = {k: v for k, v in parts["model"].items() if k not in ("vocab", "merges")}
        special = [t["content"].encode() for t in parts["added_tokens"]]
        plain = all(not t[k] for t in parts["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        if {k: parts[k] for k in FITS} | {"model": model} != FITS or not plain or any(re.search(rb"[\s.,]|[^!-~]", t) for t in special):
            raise ValueError(f"{path}: white space does not part this tokenizer's tokens as the units here take it")
        self.tok = tok
        self.special = re.compile(b"|".join(map(re.escape, special)) or rb"(?!)")
        self.units = _Units(tok, self.special)
        vocab = tok.get_vocab()
        self.text = [b""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.text[i] = b" " + t.encode()
        self.chunks: dict[bytes, tuple] = {}
        self.older: dict[bytes, tuple] = {}
        self.kept = 0
        #: Chunks read, and those that were met before.
        self.seen = self.reused = 0

    def decode(self, ids: bytes) -> bytes:
        """UTF-8 of the decoded text with one blank before: the file has no decoder, so tokens
        are joined by blanks."""
        return b"".join([self.text[i] for i in np.frombuffer(ids, "<u4").tolist()])

    def _chunk(self, chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        """(bytes before the first white space, ids of the units inside, bytes after the last one);
        no ids without white space.  Kept chunks are not encoded again."""
        self.seen += 1
        got = self.chunks.get(chunk)
        if got is None:
            got = self.older.get(chunk)
            if got is None:
                got = self._new_chunk(chunk)
            else:
                self.reused += 1
            if self.kept > MAX_CHUNK_BYTES:
                self.older, self.chunks, self.kept = self.chunks, {}, 0
            self.chunks[chunk] = got
            self.kept += len(chunk) + sum(map(len, filter(None, got)))
        else:
            self.reused += 1
        return got

    def _new_chunk(self, chunk: bytes) -> tuple[bytes, bytes | None, bytes]:
        units = chunk.split()
        self.units.trim()
        if not units:
            return (b"", b"", b"") if chunk else (b"", None, b"")
        head = b"" if chunk[0] in _WHITE else units.pop(0)
        if len(head) == len(chunk):
            return head, None, b""
        tail = b"" if chunk[-1] in _WHITE else units.pop()
        return head, b"".join(map(self.units.__getitem__, units)), tail

    def encode(self, data: bytes, cuts: Iterable[int]) -> bytes:
        """Ids of one text, as little-endian uint32, from the chunks between its cuts."""
        ids, across, lo = [], b"", 0
        for hi in (*cuts, len(data)):
            head, inner, tail = self._chunk(data[lo:hi])
            across += head
            if inner is not None:
                # The unit across the join is encoded as one, whatever its parts would give apart.
                if across:
                    ids.append(self.units[across])
                ids.append(inner)
                across = tail
            lo = hi
        if across:
            ids.append(self.units[across])
        return b"".join(ids)

    def encode_batch(self, column: pa.Array) -> Iterator[tuple[int, bytes]]:
        """(row, ids) of each text of a column; null is empty."""
        for lo, hi, data, offs in slices(column):
            raw = data.tobytes()
            cuts = cut_points(data)
            place = np.searchsorted(cuts, offs)
            low, blanks = _spaced(self._folded(raw, data, offs), offs)
            moved = offs + np.searchsorted(blanks, offs)
            cuts_at = cuts + np.searchsorted(blanks, cuts)
            low = low.tobytes()
            for r in range(hi - lo):
                a, b = int(moved[r]), int(moved[r + 1])
                # A hash that reaches over the text's start would depend on the text before.
                own = cuts_at[place[r] : place[r + 1]][cuts[place[r] : place[r + 1]] >= offs[r] + WINDOW] - a
                yield lo + r, self.encode(low[a:b], own[own < b - a].tolist())

    def _folded(self, raw: bytes, data: np.ndarray, offs: np.ndarray) -> np.ndarray:
        """The bytes with small letters for A-Z, but for units with marks or special tokens: these count in their
        own case, and the tokenizer encodes them."""
        low = bytearray(raw.lower())
        odd = [m.start() for p, where in ((_MARK, raw), (self.special, bytes(low))) for m in p.finditer(where)]
        if odd:
            edge = np.zeros(len(data) + 1, bool)
            edge[:-1] = np.isin(data, np.frombuffer(_WHITE, np.uint8))
            starts = np.unique(np.concatenate([np.flatnonzero(edge) + 1, offs]))
            ends = np.unique(np.concatenate([np.flatnonzero(edge), offs]))
            first = np.unique(starts[np.searchsorted(starts, odd, "right") - 1])
            for a, b in zip(first.tolist(), ends[np.searchsorted(ends, first, "right")].tolist(), strict=True):
                low[a:b] = raw[a:b]
        return np.frombuffer(bytes(low), np.uint8)


_codecs: dict[str, Codec] = {}


def codec(path: str) -> Codec:
    if path not in _codecs:
        _codecs[path] = Codec(path)
    return _codecs[path]


def encoded(docs: DataFrame, text: str = "text", path: str | None = None) -> DataFrame:
    """``docs`` without ``text``, with ids array<int> and decoded string.

    Every whole text is encoded, null as empty; ids equal the tokenizer's own for the whole
    text without special tokens added.  The vocabulary stays where it is and is read by path.
    """
    path = path or tokenizer_path()
    rest = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    schema = docs.select(*rest).schema.add("ids", ArrayType(IntegerType())).add("decoded", "string")

    def run(b: pa.RecordBatch):
        c, ids, texts, size, start = codec(path), [], [], 0, 0
        for row, i in c.encode_batch(b.column(b.schema.names.index(text))):
            ids.append(np.frombuffer(i, "<i4"))
            texts.append(c.decode(i)[1:].decode())
            size += len(i)
            if size > 1 << 20 or row + 1 == b.num_rows:
                keep = [b.column(k).slice(start, row + 1 - start) for k in range(len(rest))]
                yield pa.RecordBatch.from_arrays([*keep, pa.array(ids, pa.list_(pa.int32())), pa.array(texts, pa.string())], [*rest, "ids", "decoded"])
                ids, texts, size, start = [], [], 0, row + 1

    return per_batch(docs.select(*rest, text), run, schema)


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): the encoder's results as digests only."""
    path = path or tokenizer_path()

    def run(b: pa.RecordBatch):
        c, n, ids, texts = codec(path), [], [], []
        for _, i in c.encode_batch(b.column(1)):
            n.append(len(i) // 4)
            ids.append(hashlib.sha256(i).hexdigest())
            texts.append(hashlib.sha256(c.decode(i)[1:]).hexdigest())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(texts, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return per_batch(docs.select("doc_id", "text"), run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count and digests of ids and decoded text of every document.

    Null and empty texts have no tokens; repeated rows get a row each.
    """
    return digests(table(spark, sf_dir, "documents"))
