"""Secret scans: fixed patterns, and strings in sensitive context that a primed compressor finds new.

A candidate is a string of key characters in the context of a word such as ``token`` or ``passwd``: in one paragraph with it, however long, in
one object of braces, which begins with the line that opens it, or near it across a blank line.
zstandard measures the bytes that it adds to a frame primed with a dictionary of identifiers, and to one primed with the text
around it; the lesser is its novelty. Names, paths and repeated text cost few bytes, a random string nearly its length. A candidate is
reported if its novelty is a large share of its length and amounts to enough bits for a key.

The dictionary comes from the corpus itself: parts of the compound identifiers of all documents, counted by the number of
different identifiers that hold them, so that a secret, however often it was copied, is no entry.

Three kinds of secret need more than that. A secret that stands twice must not be primed by its copy, one without
digits is told from a word by its letter pairs, and a long one of few characters costs the entropy of its alphabet only.
"""

from __future__ import annotations

import bisect
import functools
import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from torrentine.llm.common import id_text, in_slices, sliced

# The base patterns.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(r"passw|passphrase|pwd|secret|token|api.?key|private.?key|access.?key|credential|bearer|authori[sz]|signature|session", re.I | re.A)
#: Shorter strings cannot reach ``KEY_BITS``. Signs of equality stand at the end only, as padding.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.~-]{11,}={0,2}")
#: Where paragraphs part, and braces of objects.
BLANK, BRACE = re.compile(r"\n[^\S\n]*\n"), re.compile(r"[{}]")
#: Bits of a key that is not near the sensitive word: so many more strings stand there that short ones would be words now and then.
WIDE_BITS = 96
#: How near a sensitive word is near, whatever lies between, how much text on each side primes the compressor, from which share of its
#: length on a candidate's marginal bytes are novel (fitted in the tests on planted keys and on words), and how many bits make a key.
REACH, AROUND, NOVEL, KEY_BITS = 64, 1024, 0.7, 60
#: Compound identifiers, their parts, in how many of them a part must stand, and the most characters of the dictionary.
COMPOUND = re.compile(r"[A-Za-z]{2,}(?:[_.-][A-Za-z]{2,})+|[a-z]{2,}(?:[A-Z][a-z]+)+")
#: What every compound identifier holds; found by its rarest character, it spares most prose the search for whole ones.
JOINT = re.compile(r"[_.-](?<=[A-Za-z].)(?=[A-Za-z])|[A-Z](?<=[a-z].)")
PART = re.compile(r"[A-Z]?[a-z]{3,15}|[A-Z]{4,15}")
LEAST_NAMES, DICTIONARY_CHARS = 5, 1 << 15

# Identifiers that code and configuration are full of.
IDENTIFIERS = (
    "password passwd username hostname localhost database connection configuration environment variable "
    "production development authorization authentication credentials certificate application/json "
    "content-type https://www.example.com http://localhost:8080 /usr/local/bin /etc/ssl/private "
    "aws_access_key_id aws_secret_access_key client_secret client_id refresh_token access_token "
    "session_token private_key public_key api_key token_type bearer signature timestamp identifier "
    "description parameters arguments function return import export default undefined exception "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx "
    "your-secret-key-here changeme example placeholder REPLACE_ME process.env os.environ getenv config.get"
)

#: Letter pairs that make up most of English, German, French and Spanish words.
PAIRS = set(
    "th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea ra ce li ch ll be ma si om ur "
    "ca el ta la ns di fo ho pe ec pr no ct us ac ot il tr ly nc et ut ss so rs un lo wa ge ie wh ee wi em ad ol rt po we na ul ni ts mo ow pa im mi ai sh "
    "ir su id os iv ia am fi ci vi pl ig tu ev ld ry mp fe bl ab gh ty op wo sa ay ex ke ui ei au ck sc da do du qu ue eu ag ap av bi bo br cr cl cu dr ef "
    "eg ep fr gr gu hr if ju ki mm nn nk ok od og oo pp rd rm rr sp tt up um va vo ze zu".split()
)


def wordy(candidate: str) -> bool:
    """Whether letters make up most of a candidate and three fifths of their pairs or more are pairs of words; in random letters a quarter are."""
    low = candidate.lower()
    pairs = [low[i : i + 2] for i in range(len(low) - 1) if low[i].isalpha() and low[i + 1].isalpha()]
    return len(pairs) * 2 >= len(low) and sum(p in PAIRS for p in pairs) * 5 >= len(pairs) * 3


def even_bytes(candidate: str) -> float:
    """Bytes of zero-order entropy of a candidate that spreads evenly over the letters and digits it uses (chi-square within five deviations); else infinite.

    Shorter ones are not judged: zstandard codes so few literals at their full length.
    """
    core = [c for c in candidate if c.isalnum()]
    n, counts = len(core), Counter(core)
    size = len(counts)
    if n < 48 or size < 2 or sum(c * c for c in counts.values()) * size / n - n > size - 1 + 5 * math.sqrt(2 * (size - 1)):
        return math.inf
    return sum(c * math.log2(n / c) for c in counts.values()) / 8


def _without(candidate: str, text: str, start: int, end: int) -> str:
    """The text around a candidate without its other occurrences, whole or as the longer parts of it; those that reach over the edge too."""
    k = end - start
    before, after = text[max(0, start - AROUND - k) : start], text[end : end + AROUND + k]
    for part in [candidate, *sorted(set(re.findall("[A-Za-z0-9]{16,}", candidate)), key=len, reverse=True)]:
        before, after = before.replace(part, "\n"), after.replace(part, "\n")
    return before[-AROUND:] + "\n" + after[:AROUND]


def key_bits(candidate: str) -> float:
    """Bits of a string drawn at random from the kinds of characters that the candidate has, in their shares; signs between them count nothing."""
    digits, lower, upper = (re.findall(f"[{c}]", candidate) for c in ("0-9", "a-z", "A-Z"))
    n, bits = len(digits) + len(lower) + len(upper), 0.0
    for kind, few, size in ((digits, "0123456789", 10), (lower, "abcdef", 26), (upper, "ABCDEF", 26)):
        if kind:
            bits += len(kind) * (math.log2(len(few) if set(kind) <= set(few) else size) + math.log2(n / len(kind)))
    return bits


def is_novel(text: str, start: int, end: int, threshold: float, dictionary: str = "") -> bool:
    """Whether the candidate text[start:end] is novel."""
    s = text[start:end]
    if key_bits(s) < KEY_BITS or wordy(s):
        return False
    least = min(threshold * len(s), 0.9 * even_bytes(s))
    return novelty(s, dictionary) >= least and novelty(s, dictionary, _without(s, text, start, end)) >= least


@functools.lru_cache(maxsize=4)
def _primed(dictionary: str) -> zstandard.ZstdCompressor:
    return _compressor(IDENTIFIERS + "\n" + dictionary)


def _compressor(primer: str) -> zstandard.ZstdCompressor:
    raw = zstandard.ZstdCompressionDict(primer.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=19, dict_data=raw, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, dictionary: str = "", around: str | None = None) -> int:
    """Bytes that the candidate adds to a frame primed with identifiers or, if it is given, with the text around it."""
    zip_ = _primed(dictionary) if around is None else _compressor(around + "\n" + IDENTIFIERS)
    return len(zip_.compress(candidate.encode())) - len(zip_.compress(b""))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches of a text, sorted; end exclusive, code points."""
    found = [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    low = text.lower()
    if "passw" in low or "secret" in low or "token" in low or "api" in low:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 18]
    return sorted(found)


class Contexts:
    """Which parts of a text stand in the context of a sensitive word; every question is a few bisections."""

    def __init__(self, text: str):
        words = [m.span() for m in SENSITIVE.finditer(text)]
        self.text, self.starts, self.ends = text, [a for a, _ in words], [b for _, b in words]
        self.blanks = [m.start() for m in BLANK.finditer(text)] if words else []
        self.braces: list[int] | None = None
        self.inner: list[tuple[int, int]] = []  # from each brace on, the innermost open object

    def holds(self, start: int, end: int) -> bool:
        """Whether a sensitive word reaches into text[start:end]."""
        i = bisect.bisect_left(self.ends, start)
        return i < len(self.ends) and self.starts[i] <= end

    def object(self, at: int) -> tuple[int, int] | None:
        if self.braces is None:
            found = [(m.start(), m[0]) for m in BRACE.finditer(self.text)]
            close, opened = {}, []
            for p, c in found:
                if c == "{":
                    opened.append(p)
                elif opened:
                    close[opened.pop()] = p
            self.braces, opened = [p for p, _ in found], []
            line = last = 0
            for p, c in found:
                line, last = max(line, self.text.rfind("\n", last, p) + 1), p
                if c == "{":
                    opened.append((max(line, opened[-1][2] if opened else 0), close.get(p, len(self.text)), p))
                elif opened:
                    opened.pop()
                self.inner.append(opened[-1][:2] if opened else (-1, -1))
        i = bisect.bisect_right(self.braces, at) - 1
        return self.inner[i] if i >= 0 and self.inner[i][0] >= 0 else None

    def least_bits(self, start: int, end: int) -> float:
        """Bits that a key needs there: ``KEY_BITS`` near a sensitive word, ``WIDE_BITS`` in one paragraph or object with it, else infinite."""
        if self.holds(start - REACH, end + REACH):
            return KEY_BITS
        i = bisect.bisect_left(self.blanks, start)
        if self.holds(self.blanks[i - 1] + 1 if i else 0, self.blanks[i] if i < len(self.blanks) else len(self.text)):
            return WIDE_BITS
        around = self.object(start)
        return WIDE_BITS if around is not None and self.holds(*around) else math.inf


def novel_spans(text: str, taken: list[tuple[int, int, int]], threshold: float = NOVEL, dictionary: str = "") -> list[tuple[int, int, int]]:
    """(start, kind, end) of novel candidates in sensitive context that are no part of a base match."""
    contexts = Contexts(text)
    if not contexts.starts:
        return []
    farthest, top = [], -1  # of the base matches up to each, sorted by start, the last end
    for _, _, b in taken:
        farthest.append(top := max(top, b))
    begins, found = [a for a, _, _ in taken], []
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        j = bisect.bisect_right(begins, start) - 1
        if j >= 0 and farthest[j] >= end:
            continue
        bits = contexts.least_bits(start, end)
        if bits < math.inf and key_bits(m[0]) >= bits and is_novel(text, start, end, threshold, dictionary):
            found.append((start, 3, end))
    return found


def find_spans(text: str | None, threshold: float = NOVEL, dictionary: str = "") -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """Base spans and all spans of a text, each sorted by start, then kind."""
    if not text:
        return [], []
    base = base_spans(text)
    more = novel_spans(text, base, threshold, dictionary)
    return base, sorted(base + more) if more else base


def identifier_dictionary(docs: DataFrame, text_col: str = "text", least_names: int = LEAST_NAMES, most_chars: int = DICTIONARY_CHARS) -> str:
    """Parts of compound identifiers of all texts that stand in ``least_names`` different identifiers or more, commonest last.

    Where they come to more than ``most_chars`` characters the commonest stay. Nothing but these comes to the driver.
    """
    schema = pa.schema([("name", pa.string())])

    def names(batches):
        for batch in sliced(batches):
            found = {n for t in batch.column(0).to_pylist() if t and JOINT.search(t) for n in COMPOUND.findall(t)}
            yield pa.RecordBatch.from_arrays([pa.array(sorted(found), pa.string())], schema=schema)

    def parts(batches):
        for batch in sliced(batches):
            rows = [p.lower() for n in batch.column(0).to_pylist() for p in set(PART.findall(n))]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.string())], schema=schema)

    different = docs.select(F.col(text_col).cast("string")).mapInArrow(names, "name string").distinct()
    counted = different.mapInArrow(parts, "name string").groupBy("name").count().where(F.col("count") >= least_names)
    rows = counted.orderBy(F.desc("count"), "name").limit(most_chars // 4).collect()  # a part has three characters or more
    kept, held = [], 0
    for r in rows:
        held += len(r.name) + 1
        if held > most_chars:
            break
        kept.append(r.name)
    return " ".join(reversed(kept))


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


FOUND = pa.schema([("doc_id", pa.int64()), *((f"n_{k}", pa.int64()) for k in KINDS[:3]), ("base_sha256", pa.string()), ("spans", pa.string())])


def scan(docs: DataFrame, threshold: float = NOVEL) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans: one row for each input row.

    Null and empty texts have no spans. Null identifiers and repeated rows are kept as they are; an
    empty table gives no rows; columns other than doc_id and text are not read. Spans of different kinds
    may overlap; ties of start go by kind.
    """
    dictionary = identifier_dictionary(docs)

    def run(batches):
        def one():
            for batch in sliced(batches):
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    base, spans = find_spans(text, threshold, dictionary)
                    n = [0, 0, 0]
                    for _, k, _ in base:
                        n[k] += 1
                    yield doc_id, *n, hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)

        yield from in_slices(one(), FOUND)

    return id_text(docs).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def redact(text: str | None, mark: str = "[SECRET]", threshold: float = NOVEL, dictionary: str = "") -> str | None:
    """The text with each run of spans that touch or overlap replaced by ``mark``; null stays null."""
    if not text:
        return text
    parts, at = [], 0
    for a, _, b in find_spans(text, threshold, dictionary)[1]:
        if a >= at or not parts:
            parts += [text[at:a], mark]
        at = max(at, b)
    return "".join(parts) + text[at:] if parts else text


def redacted(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]", threshold: float = NOVEL) -> DataFrame:
    """``docs`` with secrets in ``text_col`` replaced by ``mark``; every row and every other column stays, whatever its name.

    Null and empty texts stay as they are, as do rows with null identifiers; repeated rows are redacted alike; an empty table stays empty.
    """
    names, at = docs.columns, docs.columns.index(text_col)
    dictionary = identifier_dictionary(docs, text_col)

    def run(batches):
        for batch in sliced(batches):
            cols = list(batch.columns)
            cols[at] = pa.array([redact(t, mark, threshold, dictionary) for t in cols[at].to_pylist()], cols[at].type)
            yield pa.RecordBatch.from_arrays(cols, names=names)

    return docs.mapInArrow(run, docs.schema)
