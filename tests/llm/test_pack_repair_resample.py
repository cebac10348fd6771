"""Operators 11 to 13 against brute force."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from torrentine.llm import concat, repair, resample, tokens
from torrentine.llm.tokens import MemoEncoder, vocabulary

rng = random.Random(11)
VOCAB = ["".join(rng.choice("abcdeor") for _ in range(rng.randint(2, 6))) for _ in range(200)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(VOCAB) + (".\n" if r.random() < 0.1 else "") for _ in range(n))


DOCS = "doc_id long, text string, start long, rank string, ids string, part int"


def corpus():
    texts = [None, "", " ", "one", "<|endoftext|> said", "Ünï cödé ŝtraße", prose(3000, 1), *(prose(n, n) for n in (5, 19, 20, 21, 40, 300, 900)), prose(40, 40), "x" * 5000, "ＡＢ ab AB É1 2"]
    rows = [(i, t, 1, "r", "i", 2) for i, t in enumerate(texts)]
    return [*rows, (9, texts[9], None, None, None, None), (None, "no id here", 3, "", "", 0), (None, prose(30, 3), 3, "", "", 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS).repartition(3)


@pytest.mark.parametrize("capacity", [1024, 7])
def test_concat_and_cut(docs, capacity):
    path = vocabulary("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = concat.concat_and_cut(docs, path, capacity=capacity, end_id=0, with_ids=True).collect()
    want = Counter((i, struct.pack(f"<{len(x) + 1}I", *x, 0)) for i, x in ((r[0], tok.encode(r[1] or "", add_special_tokens=False).ids) for r in corpus()))
    stream = sorted(rows, key=lambda r: (r.sequence_id, r.offset))
    at, got, piece = 0, Counter(), b""
    for r in stream:  # gapless from the first place to the last, documents whole and in order
        assert r.sequence_id * capacity + r.offset == at and r.offset + r.length <= capacity and r.length > 0
        raw = struct.pack(f"<{r.length}I", *r.ids)
        assert r.start == len(piece) // 4 and r.ids_crc32 == zlib.crc32(raw)
        piece, at = piece + raw, at + r.length
        if len(piece) == 4 * r.doc_tokens:
            got[r.doc_id, piece] += 1
            piece = b""
    assert got == want and not piece


def test_concat_sequences(docs, spark):
    pieces = concat.concat_and_cut(docs, vocabulary("byte_bpe_50k.json"), capacity=64, end_id=0, with_ids=True)
    rows = sorted(concat.sequences(pieces, 64, pad_id=7).collect())
    assert [r.sequence_id for r in rows] == list(range(len(rows))) and all(r.n_ids == 64 and r.padding == 0 for r in rows[:-1])
    last = rows[-1]
    assert last.padding == (0 if last.n_ids & last.n_ids - 1 == 0 else 64 - last.n_ids) and len(last.ids) == last.n_ids + last.padding
    assert all(b.offset == sum(x.length for x in r.bounds[:k]) for r in rows for k, b in enumerate(r.bounds))
    assert concat.concat_and_cut(docs.limit(0), vocabulary("byte_bpe_50k.json")).count() == 0


def test_concat_reads_ids_once(docs):
    pieces = concat.concat_and_cut(docs, vocabulary("byte_bpe_50k.json"))
    assert pieces._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1


ODD = [*"ab'_-.,\n\t\r1", *"éÉ’中\u0301😀٣²Ⅷ\0\x7f“", "the", "'t", "'s", "'re", "'LL", " ", "  ", "\r\n", "23", "$$", "<|endof", "text|>"]
WHOLE = ["<|endoftext|>", "\xa0", "\x85", "\x0b", "\x1c", "\u3000"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
@pytest.mark.parametrize("step", [tokens.BATCH_BYTES, 500, 1])
def test_encode_column(monkeypatch, name, step):
    monkeypatch.setattr(tokens, "BATCH_BYTES", step)
    r, e = random.Random(step), MemoEncoder(vocabulary(name))
    texts = ["".join(r.choices(ODD + WHOLE * (r.random() < 0.2), k=r.randint(0, 14))) for _ in range(3000)]
    texts += [None, "", " ", "\n\n", " \n x\n \n", "x" * 5000, "a1" * 900, prose(900, 5), None]
    want = [e.whole(t) if t else b"" for t in texts]
    for column in (pa.array(texts), pa.array(["cut off", *texts], pa.large_string())[1:]):
        assert list(e.encode_column(column)) == want
    assert list(e.encode_column(pa.array([], pa.string()))) == [] and list(e.encode_column(pa.array([None, ""]))) == [b"", b""]


def test_encode_column_words_once():
    e = MemoEncoder(vocabulary("byte_bpe_50k.json"))
    texts = [" ".join(w + mark for w in VOCAB) for mark in ("", ".", ",", "!?", ");", "12")]
    assert list(e.encode_column(pa.array(texts))) == [e.whole(t) for t in texts]
    assert len(e.known) <= len({*VOCAB}) + 1 + 5  # the first word stands without a space too


def brute_turns(rows):
    """Damaged rows by conversation, in order."""
    found = defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        found[conv]
        s = lambda x: " " if x is None else str(x)
        dice = zlib.crc32(f"{s(conv)}:{s(turn)}".encode()) % 20
        role, text = s(role), s(text)
        if dice == 0:
            continue
        text = "" if dice == 1 else re.sub("[.!?]", "", text) if dice == 2 else text
        found[conv] += [(turn, "user" if dice == 4 else role, text)] * (2 if dice == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in found.items()}


def brute_repair(rows):
    """Cost and audit by least (cost, rest of the audit) from the end, which needs no automaton of vectors."""
    seen, faults = set(), []
    for _, role, text in rows:
        kept = re.sub(r"[\x20\x09-\x0D]", "", text)
        faults.append("blank" if not kept else "duplicate" if (role, text) in seen else "truncated" if kept[-1] not in ".!?" else "")
        seen.add((role, text))
    after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    best = [dict() for _ in range(len(rows) + 1)]
    for i in range(len(rows), -1, -1):
        for q in after:
            options = []
            if i == len(rows):
                options += [(0, "", [])] if q in ("", "a") else []
            else:
                (_, role, text), fault = rows[i], faults[i]
                step = lambda c, k, to, said: (c + best[i + 1][to][0], k + best[i + 1][to][1], said + best[i + 1][to][2])
                options.append(step(2, "D", q, []))
                if fault not in ("blank", "duplicate"):
                    more = 5 if fault else 0
                    if role[:1] and role[:1] in after[q]:
                        options.append(step(more, "K", after[q][role[:1]], [f"{role}:{text}"]))
                    for to, name in (("u", "user"), ("a", "assistant")):
                        if to in after[q]:
                            options.append(step(1 + more, "R", to, [f"{name}:{text}"]))
            best[i][q] = min(options, default=(1 << 30, "", []), key=lambda x: x[:2])
        for _ in range(4):
            for q in after:
                for to, name in (("u", "user:"), ("a", "assistant:")):
                    if to in after[q]:
                        c, k, said = best[i][to]
                        best[i][q] = min(best[i][q], (c + 5, "I" + k, [name, *said]), key=lambda x: x[:2])
    cost, audit, said = best[0][""]
    turns = {t for t, *_ in rows if t is not None}
    initials = [r[1][:1] for r in rows]
    count = Counter(faults)
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
    return (gaps, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit, hashlib.sha256("\n".join(said).encode()).hexdigest())


def conversations(n, seed, longest=14):
    r = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(r.choice([1, 2, 3, longest])):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = r.choice(["Yes.", "No!", "Why?", "cut off", "", " \t", None, f"Text {turn}. ", f"Text {turn}", "é? \n"])
            rows += [(conv, r.choice([turn, turn, turn, turn + 1, None]), role, text, "x", 1)] * r.choice([1, 1, 1, 1, 2])
    return rows


TURNS = "conv_id long, turn long, role string, text string, audit string, n int"


@pytest.mark.parametrize("parts", ["2", "40"])
def test_repair_equals_brute_force(spark, parts):
    rows = [*conversations(150, 1), *((None, t, "user", "No id.", "x", 1) for t in range(6)), *((7, None, "user", "Same.", "x", 1) for _ in range(300))]
    want = {c: brute_repair(t) for c, t in brute_turns(rows).items()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repair.repair(repair.damaged(spark.createDataFrame(rows, TURNS))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert len(got) == len(want) and {r.conv_id: tuple(r)[1:] for r in got} == want


@pytest.mark.parametrize("seed", range(3))
def test_repair_of_one_conversation_over_many_tasks(spark, seed):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "", "Well."]
    rows = [(1, t, r.choice(["user", "assistant", "assistant", "system", "x"]), r.choice([*texts, f"Number {t}.", f"Part {t}", f"Word {t}?"]), "x", 1) for t in range(900) if r.random() < 0.9]
    rows += [(2, 1, "user", "Hello.", "x", 1), (0, 5, "user", "Hello.", "x", 1)]
    want = {c: brute_repair(t) for c, t in brute_turns(rows).items()}
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        got = repair.repair(repair.damaged(spark.createDataFrame(rows, TURNS))).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert {x.conv_id: tuple(x)[1:] for x in got} == want


def test_repair_without_rows(spark):
    nothing = hashlib.sha256(b"").hexdigest()
    gone = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(gone, 0, "user", "All dropped.", "x", 1)], TURNS)
    assert [tuple(r) for r in repair.repair(repair.damaged(df)).collect()] == [(gone, 0, 0, 0, 0, 0, 0, "", nothing)]
    assert repair.repair(repair.damaged(df.limit(0))).count() == 0


def test_automaton_stays_small():
    """Vectors are bounded, so no conversation makes ever new states."""
    auto, r = repair.Automaton(), random.Random(5)
    for _ in range(300):
        d, _ = auto.state(repair.closed([0, repair.INF, repair.INF, repair.INF]))
        auto.scan(d, [(r.choice(["s", "u", "a", ""]), r.choice([repair.SOUND, repair.SOUND, repair.BLANK, repair.CUT]), 1) for _ in range(200)])
    assert len(auto.vectors) < 200


def brute_resample(docs, target, percent=5, least=20):
    def features(t):
        w = [x for x in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")) if x]
        return len(w), [zlib.crc32(" ".join(w[i : i + n]).encode()) % 10000 for n in (1, 2, 3) for i in range(len(w) - n + 1)]

    own, s, t = [features(d[1]) for d in docs], Counter(), Counter()
    for _, f in own:
        s.update(f)
    for x in target:
        t.update(features(x)[1])
    gain = [math.floor(1000 * math.log((t[k] + 1) * (s.total() + 10000) / ((s[k] + 1) * (t.total() + 10000)))) for k in range(10000)]
    rows = []
    for (doc_id, *_), (n, f) in zip(docs, own):
        h = int(hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[k] for k in f)
        rows.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in rows if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, -r[2], -r[1]))
    ranks = {id(r): k for k, r in enumerate(fit[: percent * len(fit) // 100], 1)}
    return Counter((*r[:4], ranks.get(id(r))) for r in rows)


@pytest.mark.parametrize("percent", [5, 50, 100])
def test_resample(spark, docs, percent):
    target = [prose(50, 8), None, "", prose(60, 9), "one two one"]
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(target)], "item_id long, text string, b string")
    result = resample.resample(docs, frame, percent=percent)
    assert Counter(map(tuple, result.collect())) == brute_resample(corpus(), target, percent)


def test_resample_many_ties(spark):
    rows = [(i, prose(25, i % 3)) for i in range(400)] + [(5, prose(25, 2))] * 200
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    frame = spark.createDataFrame([(prose(50, 8),)], "text string")
    result = resample.resample(df, frame, percent=30)
    assert Counter(map(tuple, result.collect())) == brute_resample(rows, [prose(50, 8)], 30)
    ids = {r.doc_id for r in result.where("rank is not null").collect()}
    assert {r.doc_id for r in resample.drawn(df, result).collect()} == ids


def test_resample_empty(spark, docs):
    frame = spark.createDataFrame([], "text string")
    assert resample.resample(docs.limit(0), frame).count() == 0
    assert Counter(map(tuple, resample.resample(docs, frame).collect())) == brute_resample(corpus(), [])
