"""Short, letter-only and other random keys without a fixed pattern."""

import string

import numpy as np
import pytest

from plumbline.llm import secrets

PROSE = "the committee decided that the new timetable for internationalisation should be published before the end of the year "


@pytest.mark.parametrize(
    "alphabet, length, least",
    [
        (string.ascii_letters + string.digits, 16, 180), (string.ascii_letters, 20, 180), (string.ascii_lowercase, 24, 160), (string.ascii_uppercase, 24, 160),
        (string.ascii_letters + "+/", 20, 180), ("0123456789abcdef", 20, 180), (string.digits, 120, 180),
    ],
)
def test_random_keys_are_found(alphabet, length, least):
    rng = np.random.default_rng(3)
    found = 0
    for _ in range(200):
        key = "".join(rng.choice(list(alphabet), length))
        spans = secrets.scan(f"{PROSE}see {key} here")
        found += any(s <= len(PROSE) + 4 and e >= len(PROSE) + 4 + length for s, e, _ in spans)
    assert found >= least


def test_ordinary_text_is_left():
    for text in (
        PROSE, "Donaudampfschifffahrtsgesellschaftskapitaen", "INTERNATIONALIZATION AND CHARACTERISTICALLY", "getElementsByClassNameAndThenSomeMore", "2024-01-15T10:22:33 +49-170-1234567", "user1234567 covid19 sha256 mp3player",
        "/usr/local/lib/python/site-packages/module_name_v2", "4111111111111111 20240115103000", "=" * 40 + "-" * 40 + "_" * 30, "a" * 50,
    ):
        assert not secrets.random_spans(text), text


@pytest.mark.parametrize(
    "name",
    [
        "https//cdn/assets/v2/img_0042-thumb", "getUserByIdV2FromCacheXYZ1", "Mozilla5AppleWebKit537Chrome120Safari537", "550e8400-e29b-41d4-a716-446655440000",
        "src/main/java/org/example/catalyst/expressions/codegen/CodeGenerator", "AbstractSingletonProxyFactoryBean", "application/x-www-form-urlencoded", "HTTP_PROXY_AUTHENTICATION_REQUIRED",
        "node_modules/plugin-transform-runtime/lib/index", "XMLHttpRequestEventTarget", "linux-gnu-x86_64-v3", "utm_source=newsletter/utm_medium=email", "www/example/com/index/html/page=12/sort=asc",
        "strengthlessness", "SHOUTINGLOUDLY", "F47AC10B-58CC-4372-A567-0E02B2C3D479",
    ],
)
def test_names_paths_and_uuids_are_left(name):
    assert not secrets.random_spans(f"{PROSE}see {name} here") and not secrets.random_spans(name)


def _p_value(value):
    """The likelihood ratio character by character."""
    kind = lambda c: 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 3
    vowel = lambda c: c.isalpha() and c.lower() in "aeiou"
    ordinary = 0.0
    for k, c in enumerate(value):
        if c.isalpha():
            before = value[k - 1] if k and value[k - 1].isalpha() else ""
            rate = secrets._VOWEL[0] if not before else secrets._VOWEL[1] if vowel(before) else secrets._VOWEL[2]
            rates = {x: v for x, v in secrets._PROSE.items() if vowel(x) == vowel(c)}
            ordinary += np.log(rate if vowel(c) else 1 - rate) + np.log(rates[c.lower()] / sum(rates.values()))
        else:
            ordinary += np.log(0.1 if c.isdigit() else 0.2)
    ordinary += max(np.log(begin[kind(value[0])]) + sum(np.log(follow[kind(a)][kind(b)]) for a, b in zip(value, value[1:])) for begin, follow in secrets._CHAINS)
    size = secrets.encoding(value)[1]
    return float(np.exp(-max(-len(value) * np.log(size) + np.log(secrets._PRIOR[size]) - ordinary, 0.0)))


def test_p_values_and_step_up_by_brute_force():
    rng = np.random.default_rng(11)
    alphabets = [string.ascii_letters + string.digits, "0123456789abcdef", string.ascii_lowercase, string.digits, string.ascii_uppercase + "234567", string.ascii_letters + "+/_-"]
    for trial in range(60):
        words = PROSE.split()[: rng.integers(3, 18)]
        for _ in range(rng.integers(0, 4)):
            words.insert(rng.integers(0, len(words)), "".join(rng.choice(list(alphabets[rng.integers(len(alphabets))]), rng.integers(5, 45))) + "=" * rng.integers(0, 3))
        text = " ".join(words + words[:1])
        cut = [w.rstrip("=") for w in words + words[:1]]
        start, end, p = secrets.stretches(text)
        assert [text[s:e] for s, e in zip(start, end)] == cut
        assert p == pytest.approx([_p_value(w) for w in cut], rel=1e-9)
        whole = sum(map(len, cut))
        ranked = sorted({w: _p_value(w) * whole / (len(w) * len(cut)) for w in cut}.items(), key=lambda x: x[1])
        ranked = [(w, q) for w, q in ranked if q <= 0.02 and not secrets.named(w) and 3 * min(secrets.battery(w, secrets.encoding(w)[1])) >= 1e-3]
        last = max((k for k, (_, q) in enumerate(ranked, 1) if q <= 0.02 * k / len(cut)), default=0)
        chosen = {w for w, _ in ranked[:last]}
        assert [text[s:e].rstrip("=") for s, e, _ in secrets.random_spans(text)] == [w for w in cut if w in chosen]


def test_awkward_texts():
    for text in ("", "=", "====", " ", "\x00", "日本語", "é" * 100, "x", "/" * 30, "\ud800abc"):
        assert secrets.random_spans(text) == []
    assert secrets.scan(None) == []
