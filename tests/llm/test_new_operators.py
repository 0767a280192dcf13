"""Prefix trie, license scan and periodic runs against brute force."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest

from cohortlake.llm.licences import NOTICES, PHRASES, Template, license_scan, needed, template_words
from cohortlake.llm.prefixtrie import prefix_trie, turns, with_shared_openings
from cohortlake.llm.runs import find_runs, numbered, periodic_runs, repeated_tail
from cohortlake.session import settle

RNG = np.random.Generator(np.random.PCG64(11))
SHA = lambda t: hashlib.sha256(t.encode()).hexdigest()
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# prefix trie


def _rebuilt(rows, every=20, below=4):
    """Turns per conversation; rows whose conversation and turn are equal must be equal here."""
    said = {}
    for c, t, r, x in rows:
        if c is not None:
            said.setdefault(c, []).append((-math.inf if t is None else t, r or "", x or ""))
    said = {c: [v[1:] for v in sorted(s)] for c, s in said.items()}
    out = {}
    for c, s in said.items():
        h = zlib.crc32(str(c).encode()) % below
        out[c] = tuple(said.get(c - int(math.fmod(c, every)), [])[:h] + s[h:])
    return out


def _trie(convs):
    nodes = {}
    for c, s in convs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(s[:d], []).append(c)
    kids = {s: [u for u in nodes if len(u) == len(s) + 1 and u[: len(s)] == s] for s in nodes}
    out = []
    for s, m in nodes.items():
        below = [u for u in nodes if u[: len(s)] == s]
        gain = sum((len(nodes[u]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", u[-1][1])) for u in below if u)
        ends = ",".join(str(c) for c in sorted(m) if convs[c] == s)
        out.append((min(m), len(s), min(nodes[s[:-1]]) if s else None, len(m), len(kids[s]), sum(not kids[u] for u in below), gain, SHA(ends)))
    return sorted(out, key=str)


def _nodes(df, **how):
    said = settle(turns(df, **how), "turns")
    return sorted((tuple(r) for r in prefix_trie(*with_shared_openings(said, 20, 4), many_members=2, block=3).collect()), key=str)


def _conversations(n):
    rows = []
    for c in [*range(n), -20, -3, 100, 1_000_000_007]:
        for t in range(int(RNG.integers(1, 7))):
            role, text = RNG.choice(["user", "", "tool"]), RNG.choice(["hi there", " x y\tz ", "", "é à  b"])
            rows.append((c, t or None, str(role) or None, str(text) or None))
    return rows


TALK = "conv_id long, turn long, role string, text string, k1 string, depth int"


def test_prefix_trie_equals_brute_force(spark):
    rows = _conversations(45) + [(None, 1, "user", "lost")]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TALK).repartition(3)
    assert _nodes(df) == _trie(_rebuilt(rows))
    assert _nodes(df.where("conv_id > 2000000000")) == []


def test_prefix_trie_of_long_copies_in_blocks(spark):
    rows = [(c, t, "user", f"w{t} of{' the same' if t < 9 - c else ''}") for c in (1, 2, 3) for t in range(10)]  # one conversation holds a third of all rows
    rows += [(c, t, "user", f"copy {t}") for c in (21, 25, 30) for t in range(12 + c % 2)]
    rows += [(4, None, None, None), (4, None, None, None), (5, 7, "user", "once"), (5, 7, "user", "once")]  # ties of equal rows
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], TALK)
    assert _nodes(df, max_rows=4) == _trie(_rebuilt(rows))


def test_equal_turns_are_in_one_order(spark):
    rows = [(40, 1, "user", t) for t in "abcde"] + [(60, 1, "user", t) for t in "edcba"]
    nodes = _nodes(spark.createDataFrame([(*r, "x", 1) for r in rows], TALK))
    assert [n[3] for n in nodes] == [2] * 6


# license scan


def _words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


def _scan(text, templates, containment, stride):
    w, places, base, met, best = _words(text), [], set(), set(), 0.0
    for t in templates:
        said, need = template_words(t), needed(t, containment)
        if t.phrase:
            here = [i for i in range(len(w)) if w[i : i + len(said)] == said]
            places += here
            base |= {t.label} if here else set()
            best = 1.0 if here else best
            continue
        for a in range(0, len(w), stride):
            both = len(set(w[a : a + 2 * stride]) & set(said))
            if both >= need:
                met.add(t.label)
                best = max(best, both / len(set(said)))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | met)), best


def _licensed():
    common = ["the", "of", "under", "mit", "license", "public", "and", "é", "any", "person", "general", "apache"]
    filler = [*common * 2, *[f"w{i}" for i in range(40)]]
    texts = [None, "", " \n", "MIT License", "mit", "license mit license MIT-LICENSE", "x " * 31 + "Apache License", "x " * 63 + "general public license " + "y " * 90, "mit license " * 400]
    for _ in range(60):
        own = [str(x) for x in RNG.choice(filler, int(RNG.integers(1, 300)))]
        t = NOTICES[int(RNG.integers(len(NOTICES)))].text.split()
        own[int(RNG.integers(len(own))) : 0] = [x for x in t if RNG.random() > 0.07]
        texts.append(" ".join(own))
    return [(i, t) for i, t in enumerate(texts)] + [(None, "the MIT license"), (None, None), (3, "apache license"), (7, texts[7]), (7, texts[7])]


LICENSED = _licensed()


@pytest.mark.parametrize(("templates", "containment", "stride"), [(PHRASES + NOTICES, 0.85, 32), ([Template("a", "mit license"), Template("b", "any person of the public"), Template("c", "license", True)], 0.5, 7)])
def test_license_scan_equals_brute_force(spark, templates, containment, stride):
    df = spark.createDataFrame([(i, t, "n", 1.0) for i, t in LICENSED], "doc_id long, text string, labels string, score double").repartition(4)
    found = license_scan(df, templates, containment, stride)
    columns = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    got = sorted(str((r["doc_id"], *[r[c] for c in columns])) for r in found.collect())
    assert got == sorted(str((i, *_scan(t, templates, containment, stride))) for i, t in LICENSED)
    assert license_scan(df.where("doc_id < 0"), templates, containment, stride).count() == 0


def test_a_template_must_fit_a_block(spark):
    df = spark.createDataFrame([(1, "x")], "doc_id long, text string")
    for text in ("", "w " * 9):
        with pytest.raises(ValueError, match="template"):
            license_scan(df, [Template("a", text)], stride=7)


# periodic runs


def _runs(w):
    """Every period, every match, every smaller period."""
    out = []
    for q in range(1, len(w) // 2 + 1):
        i = 0
        while i + q < len(w):
            a = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            size = i - a + q
            if i > a and size >= max(12, 2 * q):
                s = w[a : a + size]
                if not any(all(s[j] == s[j + p] for j in range(size - p)) for p in range(1, q)):
                    out.append((a, a + size, q))
            i = max(i, a + 1)
    return sorted(out)


def _periodic():
    kind = RNG.integers(4)
    if kind == 0:
        return RNG.choice(list("ab"), int(RNG.integers(0, 150))).tolist()
    if kind == 1:
        s = []
        while len(s) < 120:
            s += RNG.choice(list("abc"), int(RNG.integers(1, 9))).tolist() * int(RNG.integers(1, 12))
        return s
    if kind == 2:
        u = RNG.choice(list("abcd"), int(RNG.integers(1, 4))).tolist() * int(RNG.integers(1, 12)) + ["x"] * int(RNG.integers(0, 3))
        return (u * int(RNG.integers(1, 5)) + ["a"]) * int(RNG.integers(1, 4))
    u = list("ab") * int(RNG.integers(5, 30)) + ["a"]  # one run meets the next out of step: a run for every odd period
    return u + list("ab") * int(RNG.integers(3, 30)) + u


def test_runs_equal_brute_force():
    for _ in range(250):
        texts = [_periodic() for _ in range(int(RNG.integers(1, 5)))]
        w, begins = numbered(iter([[x.encode() for x in t] for t in texts]))
        want = sorted((a + int(begins[k]), b + int(begins[k]), q) for k, t in enumerate(texts) for a, b, q in _runs(t))
        assert sorted(find_runs(w, begins)) == want


def test_long_repetitions_take_little():
    for t, n in (([b"a"] * 200_000, 1), (b"one line of ten words said again and again ok".split() * 20_000, 1), (([b"a"] * 500 + [b"b"]) * 20, 21)):
        assert len(find_runs(*numbered(iter([t])))) == n


def test_periodic_runs_equal_brute_force(spark):
    rows = [(None, None), (1, ""), (2, " \n\t"), (3, "A a " * 9), (4, "  é " * 7), (4, "b"), (5, "x"), (6, "long " * 5000)]
    rows += [(i, " ".join(_periodic())) for i in range(10, 90)] + [(i, " ".join(f"v{x}" for x in RNG.integers(0, 500, int(RNG.integers(1, 400))))) for i in range(90, 250)]
    rows += rows[5:9]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows) > 15
    df = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, start long, runs string").repartition(4)
    want = []
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        if i is not None and w and (h := zlib.crc32(str(i).encode())) % 10 == 0:
            g = h // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[a + (k - a) % p] if k >= a else w[k] for k in range(len(w))]
            assert repeated_tail(re.findall(r"[^\x20\x09-\x0D]+", t), i) == w
        runs = sorted((a, b - a, q) for a, b, q in (_runs(w) if len(w) < 4000 else [(0, len(w), 1)]))
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
        gone = {k for a, n, q in runs for k in range(a + q, a + n)}
        head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        want.append((i, len(runs), *head, SHA("".join(f"{a},{n},{q}\n" for a, n, q in runs)), SHA(" ".join(x for k, x in enumerate(w) if k not in gone))))
    got = [tuple(r) for r in periodic_runs(df, planted=True, digests=True).collect()]
    assert sorted(map(str, got)) == sorted(map(str, want))
    assert periodic_runs(df.where("doc_id < 0")).count() == 0
    plain = periodic_runs(df.where("doc_id = 3")).first()
    assert (plain["runs"], plain["collapsed"]) == ("0,18,2\n", "A a")
