"""Exact, memoised encoding with the ``tokenizers`` library.

A byte-level or word BPE never merges across the place where white space follows something else, so
a text is cut there and each distinct piece is encoded by the library once per worker. Texts with
white space outside space, tab, line feed and carriage return go to the library whole, and so do texts
that name a special token, which the library encodes as that token. Columns of a byte-level BPE that
splits texts by the usual expression are cut after runs of Latin letters and of digits too, where that
expression always ends a match, so a word is encoded once whatever follows it.
"""

from __future__ import annotations

import json
import os
import re
import time
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from torrentine.llm.common import on_idle

WHITE = " \n\t\r"
PIECE = re.compile(r"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
#: Unicode white space, and separators that some libraries count as such, by code point.
RARE = (11, 12, *range(28, 32), 133, 160, 5760, 6158, *range(8192, 8204), 8232, 8233, 8239, 8287, 12288, 65279)
RARE_SPACE = re.compile("[" + "".join(map(chr, RARE)) + "]")
#: Beyond these Latin letters, lower-casing and composing a text need not be the library's, letter by letter.
NOT_PLAIN = re.compile("[^{}-{}{}-{}]".format(*map(chr, (0, 303, 305, 383))))
#: Most pieces a worker remembers (about 200 bytes each), and the longest.
MEMO_PIECES, MEMO_CHARS = 1_000_000, 64

#: Texts whose unknown pieces are encoded together; of columns, bytes of texts (or one text that is longer).
BATCH_TEXTS, BATCH_BYTES = 256, 4 << 20

#: Seconds without a text after which a worker forgets its pieces.
IDLE_S = 8.0

_loaded: dict[tuple[str, bool], "MemoEncoder"] = {}


def _cuts(fine: bool) -> tuple[bytes, bytes]:
    """Two tables of bits by byte: a text is cut between two bytes that share a bit, the first by table one, the second by table two."""
    before, after = bytearray(256), bytearray(256)
    for b in range(256):
        space, letter, digit = b in b" \n\t\r", b < 128 and chr(b).isalpha(), b in b"0123456789"
        before[b] = 0 if space else 1 | 2 * letter * fine | 4 * digit * fine
        after[b] = 1 if space else 6 * (b < 128) & ~(2 * letter | 4 * digit)
    return bytes(before), bytes(after)


class MemoEncoder:
    """Encodes texts to ids as little-endian uint32 bytes.

    Unknown pieces of some hundred texts are joined, encoded in one call and told apart again by the
    bytes that each id stands for. With ``plain_specials`` the names of special tokens are text like any other, so
    no text encodes to their ids.
    """

    def __init__(self, path: str, most: int = MEMO_PIECES, plain_specials: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}
        self.most = most
        self.used = time.monotonic()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        added = [t for t in spec.get("added_tokens") or () if not (plain_specials and t["special"])]
        #: Names of added tokens as they stand, and those that the library looks for in the normalised text.
        self.added = [t["content"] for t in added if not t["normalized"]]
        loose = [re.escape(t["content"]) for t in added if t["normalized"]]
        self.loose = re.compile("|".join(loose), re.I).search if loose else None
        kinds = re.findall(r'"type": *"(\w+)"', json.dumps(spec.get("normalizer")))
        ids = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        self.drops_space = ids(" a\nb ") == ids("a") + ids("b")
        self.lowers = self.drops_space and "Lowercase" in kinds and {*kinds} <= {"Sequence", "NFC", "Replace", "Lowercase"}
        split = spec.get("pre_tokenizer") or {}
        usual = split.get("type") == "ByteLevel" and split.get("use_regex", True) and not split.get("add_prefix_space", True)
        #: Whether texts are split by the usual expression of byte-level BPE and by nothing else.
        self.fine = usual and not spec.get("normalizer") and not any(c in t["content"] for t in added for c in WHITE) and len(ids("\n")) == 1
        self.line_id = ids("\n")[0] if self.fine else None
        self.cuts = _cuts(self.fine)
        end = spec["model"].get("end_of_word_suffix") or ""
        vocab = self.tokenizer.get_vocab()
        self.n_bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        for token, i in vocab.items():
            self.n_bytes[i] = len(token) - len(end) * bool(end and token.endswith(end))

    def whole(self, text: str) -> bytes:
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _pieces(self, text: str) -> list[str]:
        if not self.drops_space:
            return PIECE.findall(text)
        if self.lowers and not NOT_PLAIN.search(text):
            text = text.lower()
        return text.split()

    def _encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces. Joined pieces must keep their borders, so one without white space before it goes alone."""
        if self.drops_space:
            alone, joint, text = [p for p in pieces if NOT_PLAIN.search(p)], [p for p in pieces if not NOT_PLAIN.search(p)], " "
        else:
            alone, joint, text = [p for p in pieces if p[0] not in WHITE], [p for p in pieces if p[0] in WHITE and p[-1] not in WHITE], ""
            alone += [p for p in pieces if p[0] in WHITE and p[-1] in WHITE]
        found = self._encode_joint(joint, text) if joint else {}
        found.update((p, self.whole(p)) for p in alone)
        return found

    def _encode_fine(self, pieces: list[str]) -> dict[str, bytes]:
        """The same of pieces that are cut finely: those without white space before them are joined too, with a line feed after each, which is an id of its own there."""
        found = self._encode_pieces([p for p in pieces if p[0] in WHITE])
        if lines := [p for p in pieces if p[0] not in WHITE]:
            found.update(self._encode_joint(lines, "\n", self.line_id))
        return found

    def _encode_joint(self, joint: list[str], text: str, after: int | None = None) -> dict[str, bytes]:
        """Ids of pieces from one call over all, with ``text`` between them; with ``after``, its id, also at the end."""
        more = after is not None
        [e] = self.tokenizer.encode_batch_fast([text.join(joint) + text * more], add_special_tokens=False)
        ids = np.array(e.ids, np.uint32)
        ends = np.cumsum(np.fromiter((len(p.encode()) for p in joint), np.int64, len(joint))) + more * np.arange(1, len(joint) + 1)
        at = np.cumsum(self.n_bytes[ids])
        cut = np.searchsorted(at, ends)
        if len(ids) and at[-1] == ends[-1] and (at[cut] == ends).all() and not (more and (ids[cut] != after).any()):
            raw, cut = ids.tobytes(), (4 * (cut + 1)).tolist()
            return dict(zip(joint, (raw[a : b - 4 * more] for a, b in zip([0, *cut], cut))))
        return {p: self.whole(p) for p in joint}

    def _goes_whole(self, text: str) -> bool:
        return bool(RARE_SPACE.search(text) or any(name in text for name in self.added) or self.loose and self.loose(text))

    def encode_all(self, texts: list[str | None]) -> Iterator[bytes]:
        """Ids of each text; none for null. Holds those of ``BATCH_TEXTS`` at a time."""
        for at in range(0, len(texts), BATCH_TEXTS):
            yield from self._encode_some(texts[at : at + BATCH_TEXTS])

    def _encode_some(self, texts: list[str | None]) -> list[bytes]:
        self.used = time.monotonic()
        get, unknown, rows = self.known.get, {}, []
        for text in texts:
            if not text:
                rows.append(b"")
            elif self._goes_whole(text):
                rows.append(self.whole(text))
            else:
                pieces = self._pieces(text)
                ids = [get(p) for p in pieces]
                holes = [i for i, x in enumerate(ids) if x is None]
                unknown.update((pieces[i], None) for i in holes)
                rows.append((ids, [(i, pieces[i]) for i in holes]))
        if unknown:
            unknown = self._encode_pieces(list(unknown))
            self._remember(unknown)
        out = []
        for row in rows:
            if not isinstance(row, bytes):
                ids, holes = row
                for i, p in holes:
                    ids[i] = unknown[p]
                row = b"".join(ids)
            out.append(row)
        return out

    def _remember(self, found: dict[str, bytes]) -> None:
        if len(self.known) < self.most:
            self.known.update((p, x) for p, x in found.items() if len(p) <= MEMO_CHARS)

    def encode_column(self, texts: pa.Array) -> Iterator[bytes]:
        """What ``encode_all`` gives for the texts of a column. Pieces are parted and told apart in Arrow, so Python sees each once in ``BATCH_BYTES``."""
        if self.drops_space:
            yield from self.encode_all(texts.to_pylist())
            return
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < len(texts):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH_BYTES, "right")))
            yield from self._encode_step(texts.slice(at, to - at).to_pylist())
            at = to

    def _encode_step(self, texts: list[str | None]) -> list[bytes]:
        self.used = time.monotonic()
        out, plain = [b""] * len(texts), {}
        for i, text in enumerate(texts):
            if text and self._goes_whole(text):
                out[i] = self.whole(text)
            elif text:
                plain[i] = text.encode()
        if not plain:
            return out
        pieces, ends = self._parted(list(plain.values()))
        starts, raw = np.frombuffer(pieces.dictionary.buffers()[1], np.int64).tolist(), pieces.dictionary.buffers()[2].to_pybytes()
        words = [str(raw[a:b], "utf-8") for a, b in zip(starts, starts[1 : len(pieces.dictionary) + 1])]
        ids = list(map(self.known.get, words))
        if holes := [i for i, x in enumerate(ids) if x is None]:
            unknown = (self._encode_fine if self.fine else self._encode_pieces)([words[i] for i in holes])
            self._remember(unknown)
            for i in holes:
                ids[i] = unknown[words[i]]
        # the ids of each piece lie in ``flat``; those of the texts are gathered from there
        flat, which = np.frombuffer(b"".join(ids), np.uint32), pieces.indices.to_numpy()
        lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        first, n = (np.cumsum(lengths) - lengths)[which], lengths[which]
        after = np.cumsum(n)
        gathered = flat[np.repeat(first - after + n, n) + np.arange(after[-1])]
        cut = [0, *after[ends - 1].tolist()]
        for i, a, b in zip(plain, cut, cut[1:]):
            out[i] = gathered[a:b].tobytes()
        return out

    def _parted(self, texts: list[bytes]) -> tuple[pa.DictionaryArray, np.ndarray]:
        """The pieces of texts that are not empty, one after the other, and how many there are up to each text's end."""
        data = b"".join(texts)
        before, after = (np.frombuffer(data.translate(t), np.uint8) for t in self.cuts)
        border = np.zeros(len(data) + 1, bool)
        border[1:-1] = before[:-1] & after[1:]
        ends = np.cumsum([len(x) for x in texts])
        border[[0, *ends]] = True
        at = np.flatnonzero(border)
        pieces = pa.Array.from_buffers(pa.large_binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)])
        return pieces.dictionary_encode(), np.searchsorted(at, ends)

    def encode(self, text: str | None) -> bytes:
        return self._encode_some([text])[0]


def forget() -> None:
    """Drops the pieces of encoders that are idle; they are encoded again when they come."""
    for e in list(_loaded.values()):
        if time.monotonic() - e.used > IDLE_S:
            e.known.clear()


on_idle.append(forget)


def encoder(path: str, most: int = MEMO_PIECES, plain_specials: bool = False) -> MemoEncoder:
    """One encoder for each vocabulary file and Python worker, which remembers ``most`` pieces."""
    key = path, plain_specials
    if key not in _loaded:
        _loaded[key] = MemoEncoder(path, plain_specials=plain_specials)
    _loaded[key].most = most
    return _loaded[key]


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)
