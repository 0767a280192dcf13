"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import re
from itertools import combinations

import numpy as np
import public_tokenizers
import pytest

from cohortlake.llm import decontaminate, htmltext, language, toxicity, warc
from cohortlake.llm.decontaminate import contamination, without_spans
from cohortlake.llm.columns import smallest
from cohortlake.llm.exact import Patricia, exact_duplicates
from cohortlake.llm.mixing import mix, mixed_rows
from cohortlake.llm.neardup import near_duplicates
from cohortlake.llm.suffixes import remove_repeats, smallest_owner
from cohortlake.llm.tokens import _Lengths, count_tokens

RNG = np.random.Generator(np.random.PCG64(1))
VOCABULARY = ["".join(RNG.choice(list("abcdehinorst"), 4)) for _ in range(400)]
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def _text(n):
    return " ".join(RNG.choice(VOCABULARY, n))


def _corpus():
    base, shared = _text(120).split(), _text(25)
    rows = [(0, None), (1, ""), (2, "  \n "), (3, "Four words Only here"), (4, "four WORDS only here"), (5, "É à"), (6, "é à")]
    for i in range(10, 40):
        own = list(base)
        for p in RNG.integers(0, 120, int(RNG.integers(0, 8))):
            own[p] = VOCABULARY[int(RNG.integers(400))]
        rows.append((i, " ".join(own)))
    rows += [(i, f"{_text(15)} {shared} {_text(15)}") for i in range(40, 60)]
    rows += [(60, rows[8][1].upper()), (61, rows[8][1]), (62, "x" * 400), (63, "x" * 300), (64, _text(3000))]
    return rows


CORPUS = _corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "s", 1, True) for i, t in CORPUS], "doc_id long, text string, source string, n long, kept boolean").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.where("doc_id < 0")


def _rows(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_suffix_dedup_equals_brute_force(docs, none):
    seen, got = {}, _rows(remove_repeats(docs))
    for i, t in sorted(CORPUS):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for p in range(len(b) - 49):
            if seen.setdefault(b[p : p + 50], i) < i:
                gone[p : p + 50] = b"\1" * 50
        kept = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        assert (got[i]["n_bytes"], got[i]["n_removed"], got[i]["kept_sha256"]) == (len(b), sum(gone), hashlib.sha256(kept).hexdigest())
        assert got[i]["n_spans"] == len(re.findall(b"\1+", bytes(gone))) == len(got[i]["starts"])
    assert remove_repeats(none).count() == 0


@pytest.mark.parametrize("depth", [1, 4, 7, 11])
def test_radix_passes_find_the_smallest_owner(depth):
    data = RNG.integers(97, 99, 500).astype(np.uint8)
    start, owner = np.arange(500 - depth + 1), RNG.integers(0, 50, 500 - depth + 1)
    least = {}
    for p, o in zip(start, owner, strict=True):
        k = data[p : p + depth].tobytes()
        least[k] = min(o, least.get(k, o))
    assert smallest_owner(data, start, owner, depth).tolist() == [least[data[p : p + depth].tobytes()] for p in start]


def _sets():
    out = {}
    for i, t in CORPUS:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        out[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    return out


def test_near_duplicates_equal_brute_force(docs, none):
    sets, ids = _sets(), sorted(i for i, _ in CORPUS)
    part = {i: i for i in ids}
    for _ in ids:
        for a in ids:
            for b in ids:
                both = len(sets[a] & sets[b])
                if both and 100 * both >= 75 * len(sets[a] | sets[b]):
                    part[a] = part[b] = min(part[a], part[b])
    got = _rows(near_duplicates(docs))
    assert {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()} == {i: (len(sets[i]), part[i], part[i] == i) for i in ids}
    assert near_duplicates(none).count() == 0


def test_html_text(spark):
    pages = [
        (1, "u", "<html><body><nav><a>Menu</a></nav><article><h1>A &amp; B</h1><p>One <b>bold</b>er,\n text.<p>Two.<div class='comments'>Nice, really, a lot.</div></article><footer>f</footer>"),
        (2, "u", "<div id=content><p>Long text stands here, it does.<ul><li>x<li>y</ul></div><div class=ad>Buy, now, please.</div><form>Mail</form>"),
        (3, None, None), (4, "u", ""), (5, "u", "<script>var a = '<p>no</p>'"), (6, "u", "plain &lt; text <!-- never closed"),
    ]
    got = {r["page_id"]: r for r in htmltext.extract(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert got[1]["text"] == "A & B One bolder, text. Two."
    assert got[2]["text"] == "Long text stands here, it does. x y"
    assert [got[i]["text"] for i in (3, 4, 5)] == ["", "", ""] and got[6]["text"] == "plain < text" and got[6]["n_chars"] == 12
    assert htmltext.main_text("<p>" * 3000 + "<a \"'" * 500 + "x").count("x") <= 1


def test_html_text_gives_all_content_paths():
    said = [" ".join(f"Part {k} has {w}, as said, in line {i}." for i, w in enumerate(VOCABULARY[20 * k : 20 * k + 12])) for k in range(4)]
    teaser = "Read more, now, about this."
    page = f"<div id=content><p>{said[0]}</p><p>{said[1]}</p></div>"
    assert htmltext.main_text(f"{page}<article class=card><p>{teaser}</p></article>") == f"{said[0]} {said[1]} {teaser}"
    assert htmltext.main_text("".join(f"<article><p>{x}</p></article>" for x in said)) == " ".join(said)
    assert htmltext.main_text(f"<main>{page}<article><p>{said[2]}</p></article></main>") == " ".join(said[:3])
    assert htmltext.main_text(f"<div><h1>Title</h1><div id=a><p>{said[0]}<p>{said[1]}<p>{said[2]}</div><div id=b><p>{said[3]}</div></div>") == " ".join(["Title", *said])
    assert htmltext.main_text(f"<ul><li><a>Home</a><li><a>News</a></ul><h1>Title</h1><div id=t><p>{said[0]}<ul><li><a>x</a></ul></div><div id=u>{said[1]}</div>") == f"Title {said[0]} x {said[1]}"
    named = f"<article><h2 id=related-work>Related work</h2><section id=legal><p>{said[0]}</p></section><section class=comments><p>{said[1]}</p></section><div class=notice><p>{said[2]}</p></div>"
    assert htmltext.main_text(named + "<div class=related><a>One</a> <a>Two, more, so.</a></div><div class=header>Site</div></article>") == " ".join(["Related work", *said[:3]])
    assert htmltext.main_text(f"<div class=ad>{said[0]}</div><div class=comments>{said[1]}</div>") == ""


def test_mix_targets_and_reruns(spark, none):
    rows = [(i, _text(int(RNG.integers(1, 60))), None if i % 7 == 0 else f"s{i % 4}") for i in range(300)] + [(300, None, "s1"), (301, "", "empty")]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plan = mix(table, [3, 1, 2], 1.5, seed=4, block_rows=20)
    got = plan.collect()
    total = sum(r["size"] for r in got)
    targets, taken = {r["source"]: (r["source_size"], r["target"]) for r in got}, {}
    for r in got:
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        assert r["taken"] <= 2 * r["size"]
    weights = dict(zip(sorted(s for s in targets if s is not None) + [None], [3, 1, 2] * 3, strict=False))
    want, open_, rest = {}, set(targets), 1.5 * total
    while open_:  # clamp and reshare until none is above
        level = rest / sum(weights[s] for s in open_)
        over = {s for s in open_ if weights[s] * level > 2 * targets[s][0]}
        if not over:
            want |= {s: weights[s] * level for s in open_}
            break
        want |= {s: 2.0 * targets[s][0] for s in over}
        rest -= sum(want[s] for s in over)
        open_ -= over
    assert {s: pytest.approx(t) for s, (_, t) in targets.items()} == want
    assert all(abs(taken[s] - want[s]) <= 30 for s in want)
    assert sorted(map(tuple, mix(table.repartition(5), [3, 1, 2], 1.5, seed=4, block_rows=20).collect())) == sorted(map(tuple, got))
    assert mixed_rows(table, plan).count() == sum(r["taken"] // r["size"] for r in got if r["size"])
    assert mix(none, [1], 1.0).count() == 0


def test_toxicity_catches_altered_words(spark, none):
    bad = ["wretchkin", "gloompuff", "stinkwort"]
    rows = [(i, f"{_text(40)}. {bad[i % 3] if i % 4 == 0 else ''} {_text(5)}", int(i % 4 == 0)) for i in range(400)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic long"))
    assert sorted(model.markers) == sorted(bad)
    ask = [(0, None), (1, ""), (2, _text(2000)), (3, f"{_text(50)} w.r.e.t.c.h.k.i.n {_text(9)}"), (4, f"you gloo-mpuff {_text(9)}"), (5, f"s t i n k w o r t {_text(3)}"), (6, "gloomppuff")]
    got = _rows(toxicity.score(spark.createDataFrame(ask, "doc_id long, text string"), model))
    assert [got[i]["predicted"] for i, _ in ask] == [0, 0, 0, 1, 1, 1, 1]
    assert all(0 <= r["score"] <= 1 for r in got.values()) and toxicity.score(none, None).count() == 0


def test_toxicity_learns_rare_words_beside_a_dominant_one(spark, monkeypatch):
    own = np.random.Generator(np.random.PCG64(55))
    rare = sorted({"".join(own.choice(list("fgjklmpquvwxyz"), 7)) for _ in range(50)})
    many = ["".join(x) for x in own.choice(list("abcdehinorst"), (20000, 5))]
    said = lambda n: " ".join(own.choice(many, n))
    rows = [(f"{said(20)} {rare[i % 50]} {'gloompuff' if i % 5 else ''} {said(4)}", 1) for i in range(500)] + [(said(25), 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, "text string, toxic long").repartition(4)
    ask = spark.createDataFrame([(i, f"{said(30)} {w}") for i, w in enumerate(["gloompuff", *rare, "a"])], "doc_id long, text string")
    for group in (256, 20):
        monkeypatch.setattr(toxicity, "GROUP", group)
        model = toxicity.learn(frame)
        assert sorted(model.markers) == sorted(["gloompuff", *rare]) and len(model.machines) == -(-51 // group)
        got = _rows(toxicity.score(ask, model))
        assert [got[i]["predicted"] for i in range(52)] == [1] * 51 + [0]


def test_toxicity_scores_equal_brute_force(spark):
    bad = ["wretchkin", "gloompuff", "stinkwort"]
    rows = [(i, f"{_text(40)}. {bad[i % 3] if i % 4 == 0 else ''} {_text(5)}", int(i % 4 == 0)) for i in range(300)]
    model = toxicity.learn(spark.createDataFrame(rows, "doc_id long, text string, toxic long"))

    def triples(word):
        found = {}
        for i, j, k in combinations(range(len(word)), 3):
            u = word[i] + word[j] + word[k]
            found[u] = found.get(u, 0.0) + toxicity.DECAY ** (k - i + 1)
        return found

    def like(a, b):
        x, y = triples(a), triples(b)
        size = math.sqrt(sum(v * v for v in x.values()) * sum(v * v for v in y.values()))
        return sum(v * y.get(u, 0.0) for u, v in x.items()) / size

    marks = bad + ["among", "letters", "bramble"]
    own = np.random.Generator(np.random.PCG64(8))
    whiten, weights = own.normal(size=(6, 6)), own.normal(size=6)
    machine = toxicity.Machine(marks, whiten, weights, 0.25)
    words = ["wretchkin", "wretch-kin", "ab", "abc", "gloompuffs", "xyzzyq", "bramblewood" * 2, "ÄÖÜäöü"]
    want = [max(np.array([like(w, m) for m in marks]) @ whiten @ weights + 0.25, -1.5) if len(w) > 2 else -1.5 for w in words]
    assert np.allclose(machine.margins(words), want, atol=1e-4)

    texts = [None, "", "...", *(r[1] for r in rows[:12]), "a w.retch-kin b", "g l o o m p u f f", "st1nkw0rt", "x" * 5000, f"{_text(500)} stinkwortt"]
    table = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)] * 2, "doc_id long, text string, score string")
    got = toxicity.score(table, model).collect()
    assert len(got) == 2 * len(texts)
    for r in got:
        spellings = [f for token in toxicity.tokens(texts[r["doc_id"]] or "") for f in toxicity.forms(token)]
        margin = max((m.margins([f])[0] for f in spellings for m in model.machines), default=toxicity.LOWEST)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-model.slope * (margin - model.middle))), abs=1e-9)
        assert r["predicted"] == int(r["score"] >= 0.5)


def test_toxicity_counts_near_copies_once_and_ties_of_the_order(spark):
    own = np.random.Generator(np.random.PCG64(12))
    many = ["".join(x) for x in own.choice(list("abcdehinorst"), (3000, 5))]
    said = lambda n: [str(w) for w in own.choice(many, n)]
    page = said(60)
    copies = [" ".join([*page[:i], "x", *page[i + 1 :]]) for i in range(20)]
    apart = [" ".join(said(60)) for _ in range(200)]
    ids = list(range(220))
    groups = toxicity.near_copies([(i, list(r["least"])) for i, r in zip(ids, _minima(spark, copies + apart), strict=True)])
    assert len({groups[i] for i in ids[:20]}) == 1 and len({groups[i] for i in ids[20:]}) == 200
    rows = [(f"{' '.join(said(30))} gloompuff", 1) for _ in range(40)] + [(t, 1) for t in copies] * 2 + [(t, 0) for t in apart] * 3
    assert toxicity.learn(spark.createDataFrame(rows, "text string, toxic long")).markers == ["gloompuff"]
    assert toxicity.learn(spark.createDataFrame([(None, 1), ("", 0), ("a", None)], "text string, toxic long")) is None


def _minima(spark, texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "label long, body string").coalesce(1)
    return rows.mapInArrow(toxicity._minima, "id long, least array<long>").collect()


@pytest.mark.parametrize("wanted", [1, 7, 500, 5000])
def test_smallest_hashes(spark, wanted):
    own = np.random.Generator(np.random.PCG64(2))
    values = {"a": own.integers(-(2**63), 2**63, 3000).tolist(), "b": [5] * 4000, "c": own.integers(0, 100, 900).tolist()}
    table = spark.createDataFrame([(k, v) for k, vs in values.items() for v in vs], "label string, at long")
    last, total = smallest(table, "label", "at", dict.fromkeys(values, wanted))
    assert total == {k: len(v) for k, v in values.items()}
    assert last == {k: sorted(set(v))[:wanted][-1] for k, v in values.items()}


def test_subsequence_kernel_equals_enumeration():
    from itertools import combinations

    def slow(s, t):
        total = 0.0
        for a in combinations(range(len(s)), 3):
            for b in combinations(range(len(t)), 3):
                if all(s[x] == t[y] for x, y in zip(a, b, strict=True)):
                    total += toxicity.DECAY ** (a[-1] - a[0] + 1 + b[-1] - b[0] + 1)
        return total

    got = toxicity.subsequence_kernel(["banana", "cabana"], ["bandana", "an", "cab"])
    assert np.allclose(got, [[slow(s, t) for t in ("bandana", "an", "cab")] for s in ("banana", "cabana")], rtol=1e-4)


def test_language_profiles(spark, none):
    speak = {"x": "abcde", "y": "efghi", "z": "äöüßk"}
    word = lambda l: "".join(RNG.choice(list(speak[l]), 5))
    rows = [(i, " ".join(word(l) for _ in range(30)), l) for i, l in enumerate("xyz" * 40)] + [(900, None, "x"), (901, "123 ---", "x"), (902, "abcde", None)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(table.where("doc_id % 3 != 1 or doc_id % 2 = 0"))
    got = _rows(language.identify(table, model))
    assert all(got[i]["lang_pred"] == l for i, _, l in rows[:120]) and got[902]["lang_pred"] == "x"
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und"
    assert language.identify(none, model).count() == 0 and _rows(language.identify(table, {}))[0]["lang_pred"] == "und"


def test_warc_round_trip(spark, tmp_path):
    rows = [(i, f"http://h{i % 3}.example.com/{i}", ("p" * 99 if i % 5 == 0 else f"body é {i % 4} " * 30)) for i in range(60)] + [(60, None, None), (61, "ht tp:\n//bad", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    index = warc.write_archives(pages, str(tmp_path / "w"), run_bytes=4000)
    merged = warc.merge_indexes(index).orderBy("range", "position").collect()
    assert [warc._order(r.asDict()) for r in merged] == sorted(warc._order(r.asDict()) for r in merged) and len(merged) == 62
    back = {r["id"]: r for r in warc.read_archives(index, payloads=True).collect()}
    first = {}
    for i, _, h in rows:
        b = (h or "").encode()
        owner = first.setdefault(b, i) if len(b) >= 100 else i
        assert (back[i]["payload_bytes"], back[i]["payload_digest"]) == (len(b), hashlib.sha256(b).hexdigest())
        assert (back[i]["record_type"], back[i]["refers_to"]) == (("response", None) if owner == i else ("revisit", owner))
        assert owner != i or back[i]["payload"] == b


def test_loser_tree():
    for k in range(6):
        runs = [sorted(RNG.integers(0, 20, n).tolist()) for n in RNG.integers(0, 9, k)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


@pytest.mark.parametrize("limit", [64 << 20, 600])
def test_exact_groups(docs, none, limit):
    groups = {}
    for i, t in CORPUS:
        groups.setdefault((t or "").translate(LOWER), []).append(i)
    got = _rows(exact_duplicates(docs, keep="max", trie_bytes=limit))
    for body, ids in groups.items():
        for i in ids:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(ids), len(ids), i == max(ids))
            assert got[i]["text_sha256"] == hashlib.sha256(body.encode()).hexdigest()
    assert exact_duplicates(none).count() == 0


def test_patricia_trie():
    trie, keys = Patricia(), [b"", b"a", b"ab", b"abc", b"abd", b"b", b"abc"]
    for i, k in enumerate(keys):
        trie.insert(k, i, i, 1)
    assert sorted(trie.drain()) == [(k, min(x), max(x), len(x)) for k in sorted(set(keys)) for x in [[i for i, y in enumerate(keys) if y == k]]]


def test_token_counts_equal_whole_texts(docs, none):
    from tokenizers import Tokenizer

    file = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(file)
    got = _rows(count_tokens(docs, file, limit=50, drops_space=True))
    for i, t in CORPUS:
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i]["n_tokens"], got[i]["n_bytes"], got[i]["over_limit"]) == (n, len((t or "").encode()), n > 50)
    odd = ["a<|startoftext|>b <|endoftext|>", "<|EndOfText|> x", "́ x ́y", "ΑΣ ΑΣ. x", "it's 'S x's", "a\x1cb c\xa0d", "end. a,b, c... , ."]
    assert _Lengths(lambda x: [len(e.ids) for e in tok.encode_batch(x, add_special_tokens=False)]).of([o.encode() for o in odd]) == [len(tok.encode(o, add_special_tokens=False).ids) for o in odd]
    assert count_tokens(none, file).count() == 0


def test_contamination_equals_brute_force(spark, docs, none):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    item = CORPUS[-1][1].split()
    items = [(1, " ".join(item[100:112]).upper()), (2, "four; words?"), (3, None), (4, "..."), (5, " ".join(item[200:210])), (6, _text(12)), (6, CORPUS[45][1])]
    got = _rows(contamination(docs, spark.createDataFrame(items, "item_id long, text string")))
    for i, t in CORPUS:
        w, hit, named = words(t), set(), set()
        for item_id, it in items:
            iw = words(it)
            n = min(10, len(iw))
            cut = {tuple(iw[j : j + n]) for j in range(len(iw) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if n and tuple(w[p : p + n]) in cut:
                    hit |= set(range(p, p + n))
                    named.add(str(item_id))
        assert (got[i]["n_words"], got[i]["n_hit"], got[i]["items"], got[i]["contaminated"]) == (len(w), len(hit), sorted(named), bool(hit))
    found = contamination(docs, spark.createDataFrame(items, "item_id long, text string"))
    clean = _rows(without_spans(docs, found))
    assert len(clean[64]["clean_words"].split()) == 3000 - got[64]["n_hit"]
    assert contamination(none, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert contamination(docs, none.selectExpr("doc_id as item_id", "text")).where("contaminated").count() == 0


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_contamination_moves_windows_not_documents(spark, docs, monkeypatch, most):
    plans, settle = {}, decontaminate.settle

    def seen(df, label):
        plans[label] = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
        return settle(df, label)

    items = spark.createDataFrame([(1, CORPUS[-1][1][:200]), (2, "É à")], "item_id long, text string")
    want = contamination(docs, items, size=10).collect()
    monkeypatch.setattr(decontaminate, "settle", seen)
    monkeypatch.setattr(decontaminate, "MAX_BROADCAST_WINDOWS", most)
    assert sorted(map(str, contamination(docs, items, size=10).collect())) == sorted(map(str, want))
    plan = plans["contaminated"]
    assert sum("strategy=broadcast" in x for x in plan) == (2 if most else 0)
    sides = [plan[i + 1] for i, x in enumerate(plan) if "Join LeftSemi" in x]
    assert len(sides) == 2 and (most or not any(", w#" in x for x in sides))
