"""Novel secrets in the structure of code and configuration, of forms that no other test plants, and real code without any."""

import base64
import hashlib
import pathlib
import sysconfig
import time

from torrentine.llm import secrets

FILLER = "\n".join(f'  "option_{i}": "a plain value of line {i}",' for i in range(12))
TEMPLATES = [
    '{{"name": "credential", "note": "' + "some plain words here " * 10 + '", "value": "{}"}}',
    '"credentials": {{\n' + FILLER + '\n\n  "value": "{}"\n}}',
    "authorization of the service, " + "with words in between, " * 14 + "{} and more",
    "def connect(session):\n" + "    # a line of code\n" * 20 + '    return open_it("{}")\n',
    "bearer:\n" + "  - item of a list\n" * 20 + "  - {}\n",
    "const settings = {{ signature: {{\n" + FILLER + "\n\n" + FILLER + '\n  raw: "{}" }} }};',
    "{}\n" + "# the passphrase stands below, in this paragraph\n" * 8,
]


def keys():
    for i in range(40):
        digest = hashlib.sha512(f"key {i}".encode()).digest()
        yield base64.b64encode(digest[:30]).decode()
        yield base64.urlsafe_b64encode(digest[:21]).decode()
        yield base64.b32encode(digest[:20]).decode()
        yield digest[:16].hex().upper()


def novel(text):
    return [text[a:b] for a, k, b in secrets.find_spans(text)[1] if k == 3]


def test_context_is_the_structure_of_the_text():
    found = total = 0
    for i, key in enumerate(keys()):
        for template in TEMPLATES:
            total += 1
            found += key in novel(template.format(key))
    assert found / total >= 0.9


def test_other_paragraphs_and_objects_are_no_context():
    key = base64.b64encode(hashlib.sha256(b"k").digest()).decode()[:40]
    apart = "\n\n" + "plain words. " * 10 + "\n\n"
    assert novel("credential" + apart + key) == novel(key + apart + "credential") == []
    assert novel('{"credential": "x",' + apart + '"a": 1}' + apart + '{"v": "' + key + '"}') == []
    assert novel('{"credential": "x",' + apart + '"a": {"v": 1}, "b": "' + key + '"}') == [key]
    assert novel("credential\n" + "plain words. " * 10 + key) == [key] and novel("}}} {" + apart + key + " { credential") != []
    assert novel("credential " + "plain words. " * 10 + "pfchachpfkeit nuedoasarjaos") == []


def test_real_code_has_few_false_alarms():
    """Modules of the standard library that hold sensitive words, as they are."""
    files = strings = alarms = 0
    for path in sorted(pathlib.Path(sysconfig.get_paths()["stdlib"]).glob("*.py")):
        text = path.read_text(errors="replace")
        contexts = secrets.Contexts(text)
        if contexts.starts:
            files += 1
            strings += sum(contexts.least_bits(*m.span()) < float("inf") for m in secrets.CANDIDATE.finditer(text))
            alarms += len(novel(text))
    print(files, strings, alarms)
    assert alarms <= 0.02 * strings


def test_braces_and_blank_lines_take_linear_time():
    for unit in ("{}", "{", "}", "{\n\n", "a_long_enough_name {}\n\n", "{ a_long_enough_name"):
        took = []
        for n in (20_000, 160_000):
            began = time.process_time()
            secrets.find_spans("credential\n\n" + "plain words. " * 9 + "\n\n" + unit * n + " a_long_enough_name")
            took.append(time.process_time() - began)
        assert took[1] < 24 * max(took[0], 0.05), unit
