import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest

from oddloom.llm import alignment, spelling, url_filter

from .conftest import AWKWARD

A_PATH, B_PATH = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


# spelling variants ------------------------------------------------------------------------

def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def plain_groups(rows, least_chars=6, least_count=5, factor=5, every=199):
    n = Counter()
    for ident, text in rows:
        for run in re.findall("[A-Za-z\u00C0-\u00FF]+", text or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if ident is None else ident}:{run}".encode())
            if h % every == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    n = {w: c for w, c in n.items() if len(w) >= least_chars and c >= least_count}
    near = {w: [v for v in n if one_apart(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= factor * n[w] else None
    out = {}
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None)
    return out


def spelled_rows(seed, docs=60, stems=40):
    rng = random.Random(seed)
    letters = "abcÀéÿ"
    words = []
    for _ in range(stems):
        stem = "".join(rng.choice(letters) for _ in range(rng.randint(5, 9)))
        words += [stem] * 150
        for _ in range(6):
            at, new = rng.randrange(len(stem)), rng.choice(letters)
            words += [rng.choice([stem[:at] + stem[at + 1:], stem[:at] + new + stem[at:], stem[:at] + new + stem[at + 1:]])] * rng.choice([1, 5, 6, 30])
    rng.shuffle(words)
    rows = [(i, "") for i in range(docs)]
    for k, w in enumerate(words):
        i = k % docs
        rows[i] = (i, rows[i][1] + rng.choice([" ", "\n", "-", "1", "Š"]) + (w.upper() if w.isascii() and k % 3 == 0 else w))
    return rows


@pytest.mark.parametrize("tile", [spelling.TILE, 7])
def test_spelling_against_brute_force(docs, tile):
    rows = spelled_rows(3) + AWKWARD + [(None, "abcabcabc " * 9), (900, "abcabcabd " * 5), (900, "x" * 5000 + " " + ("y" * 3000 + " ") * 6)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.group(docs(rows), tile=tile).select(
        "word", "form", "root", "n", "n_near", "form_n").collect()}
    want = plain_groups(rows)
    assert got == want and sum(v[0] is not None for v in want.values()) > 20


def test_spelling_slips_and_chains(docs):
    rows = [(i, "aaaaaaa " * 200 + "aaaaaab " * 30 + "aaaaabb " * 5 + "aaaaaac " * 200) for i in range(3)]
    got = {r["word"]: tuple(r)[1:] for r in spelling.group(docs(rows), every=10**9).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got["aaaaabb"] == ("aaaaaab", "aaaaaaa", 15, 1, 90) and got["aaaaaab"][:2] == ("aaaaaaa", "aaaaaaa")
    runs = ["".join(c) for c in zip(*[iter("abcdefghijklmnopqrstuvwxyz" * 40)] * 7)]
    for every in (2, 5):
        rows = [(i, " ".join(runs)) for i in range(12)]
        got = {r["word"]: r["n"] for r in spelling.word_counts(docs(rows), every=every).collect()}
        assert got == {w: v[2] for w, v in plain_groups(rows, every=every).items()}


def test_index_walk_against_brute_force():
    rng = random.Random(5)
    words = sorted({"".join(rng.choice("ab") for _ in range(rng.randint(6, 8))) for _ in range(300)})
    for size in (6, 7):
        block = [(w, i) for i, w in enumerate(words) if len(w) in (size, size + 1)]
        index = spelling.Index(block)
        for word, _ in block:
            want = {v for v, _ in block if one_apart(word, v) and size in (len(word), len(v))}
            assert {v for v, _ in index.near(word, size, True)} == want
            half = {v for v in want if v[:size // 2] != word[:size // 2]}
            assert {v for v, _ in index.near(word, size, False)} == half


def test_spelling_empty(docs):
    assert spelling.group(docs([(1, None), (2, "ab cd")])).count() == 0
    assert spelling.group(docs([(1, "x")]).limit(0)).count() == 0


# URL filter -------------------------------------------------------------------------------

URLS = [None, "", "no scheme", "http://", "HTTP://A.Example.COM/en/x?y#z", "https://www.example.com/en/1", "x://example.com/en/",
        "http://example.com/en", "http://sub.www.example.com/en/?a=/de/", "http://a.net/es/1", "http://a.net/esx/", "http://net/fr/é",
        "http://b.org?x=://c.com/", "http://É.ORG#/en/", "http://c.net:80/fr/", "http://com/", "a://b://c.com/", "http://x.com", "http://xcom/",
        "http://big-casino-poker.org/de/1", "http://city-library.org/de/1", "http://" + "l" * 50_000 + ".org/" + "p" * 50_000, "l1\n://h.net\n/fr/"]


def plain_judge(url, model):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host):])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(r), r, v) for v, r in url_filter.RULES for h, p in [(r[:r.index("/")], r[r.index("/"):])]
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    rule, verdict = max(fits)[1:] if fits else (None, None)
    if verdict is None:
        found = {k + t[i:i + n] for k, t in (("h", f"^{host}$"), ("p", f"^{path}$")) if len(t) > 2 for n in (3, 4, 5) for i in range(len(t) - n + 1)}
        at = sorted({zlib.crc32(g.encode()) % url_filter.BUCKETS for g in found})
        z = model.bias + sum(model.weights[i] for i in at) / max(len(at), 1) ** 0.5
        verdict = "block" if z >= 0 else "allow"
    return host, path, rule, verdict


def test_url_filter_against_plain_version(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    rows = [(i, u, "x", "x") for i, u in enumerate(URLS)] + [(None, URLS[5], "x", "x"), (5, URLS[5], "x", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, __says string")
    got = url_filter.judge(pages, model, keep=("page_id", "host", "__says"))
    assert got.columns == ["page_id", "__says", "host", "path", "rule", "score", "verdict"]
    want = sorted(((i, *plain_judge(u, model)) for i, u, _, _ in rows), key=str)
    assert sorted((tuple(r) for r in got.select("page_id", "host", "path", "rule", "verdict").collect()), key=str) == want
    assert {r[3] for r in want if r[0] is not None and r[0] in (19,)} == {None} and url_filter.judge(pages.limit(0), model).count() == 0


def test_url_model_tells_unseen_urls_apart(spark):
    model = url_filter.train(url_filter.labelled_urls(spark))
    bad = ["http://lucky-casinos.org/de/8", "https://www.pokerbet.info/", "http://cheappills4u.net/en/1", "http://m.xxx-webcams.org/fr/",
           "http://adtracker.example.org/x", "http://spamfarms.org/en/3"]
    good = ["http://townlibrary.org/de/8", "https://www.weathernews.info/", "http://gardenbooks.net/en/1", "http://m.science-museum.org/fr/",
            "http://schoolwiki.example.org/x", "http://oldbridge.org/en/3", "http://qwzk.org/"]
    score = lambda u: model.score(*plain_judge(u, model)[:2])
    assert all(score(u) >= 0.5 for u in bad) and all(score(u) < 0.5 for u in good)


def test_url_model_is_the_maximum_of_its_likelihood(spark):
    rows = [r for r in url_filter.labelled_urls(spark).collect()][::7]
    urls, y = [plain_judge(r["url"], url_filter.Model(np.zeros(url_filter.BUCKETS), 0))[:2] for r in rows], np.array([r["blocked"] for r in rows])
    model = url_filter.fit(urls, y.tolist())
    gap = y - np.array([model.score(*u) for u in urls])
    slope = np.zeros(url_filter.BUCKETS)
    for (h, p), g in zip(urls, gap):
        at = url_filter.grams(h, p)
        slope[at] += g / len(at) ** 0.5
    assert np.abs(slope - url_filter.RIDGE * model.weights).max() < 1e-6 and abs(gap.sum() - url_filter.RIDGE * model.bias) < 1e-6


def test_url_model_without_both_classes(spark):
    model = url_filter.train(spark.createDataFrame([("http://a.org/", 1), (None, 0), ("http://b.org/", None)], "url string, blocked int"))
    assert model.score("a.org", "/") < 0.5
    twice = [("http://casino.org/", 0), ("http://casino.org/", 1), ("http://school.org/", 0)]
    model = url_filter.train(spark.createDataFrame(twice, "url string, blocked int"))
    assert model.score("casino.org", "/") > 0.5 > model.score("school.org", "/")


# alignment --------------------------------------------------------------------------------

def plain_alignment(rows):
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A_PATH), sentencepiece.SentencePieceProcessor(model_file=B_PATH)
    a.encode_special_tokens = True
    letters = {c: bytes([v]) for c, v in alignment.byte_letters().items()}
    found = []
    for ident, text in rows:
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        xs = [b"".join(letters[c] for c in a.id_to_token(i)) for i in x]
        ys = [bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in ((i, b.id_to_piece(i)) for i in y)]
        if not text or not b"".join(xs) == b"".join(ys) == (" " + text).encode():
            found.append((ident, [], [], [], []))
            continue
        xe, ye = np.cumsum([len(t) for t in xs]).tolist(), np.cumsum([len(t) for t in ys]).tolist()
        links = [(x[i], y[j]) for i in range(len(x)) for j in range(len(y))
                 if max(xe[i] - len(xs[i]), ye[j] - len(ys[j])) < min(xe[i], ye[j])]
        groups, at = [], 0
        for end in sorted(set(xe) & set(ye)):
            inside = [[t for t, e in zip(ids, ends) if at < e <= end] for ids, ends in ((x, xe), (y, ye))]
            groups.append(",".join(map(str, inside[0])) + "|" + ",".join(map(str, inside[1])))
            at = end
        found.append((ident, x, y, groups, links))
    n = Counter(p for f in found for p in f[4])
    top = {}
    for (_, j), c in n.items():
        top[j] = max(top.get(j, 0), c)
    return sorted([(ident, len(x), len(y), len(g), len(links), sum(n[p] == top[p[1]] for p in links), sum(n[p] for p in links),
                    hashlib.sha256(";".join(g).encode()).hexdigest() if x else "") for ident, x, y, g, links in found], key=str), n


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@pytest.fixture(scope="module")
def mixed_texts():
    rng = random.Random(8)
    parts = ["the", "ing", " ", " ", " ", "\n", "  ", "é", "\U0001F600", "'s", "12345", ".", ", ", "\t", "\u2581", "\xa0", "\u3000", "x\u0301", "ß",
             "<|endoftext|>", "</s>", "\x1c", "\x85", "日本", "\r\n", "don't ", "   ", "ab"]
    rows = [(i, "".join(rng.choice(parts[:14] if i % 3 else parts) for _ in range(rng.randint(0, 40)))) for i in range(150)]
    return rows + [r for r in AWKWARD if r[1] is None or len(r[1]) < 1000] + [(300, "the thing is " * 600), (301, "\u2581"), (302, "a\u2581b")]


@pytest.mark.parametrize("radix, salts, run_docs", [(alignment.RADIX, alignment.SALTS, None), (3, 2, 7)])
def test_alignment_against_brute_force(docs, mixed_texts, monkeypatch, radix, salts, run_docs):
    want, counts = plain_alignment(mixed_texts)
    got = alignment.align(docs(mixed_texts), A_PATH, B_PATH, radix, salts)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.select(*COLUMNS).collect()), key=str) == want
    listed = {(r["a_id"], r["b_id"]): r["n"] for r in alignment.pairs(docs(mixed_texts), A_PATH, B_PATH, radix, salts).collect()}
    assert listed == dict(counts)


def test_alignment_without_units_is_the_same(mixed_texts):
    cut, whole = alignment.Aligner(A_PATH, B_PATH), alignment.Aligner(A_PATH, B_PATH)
    assert cut.cut is not None
    whole.cut = None
    texts = [t for _, t in mixed_texts if t]
    assert cut(texts) == whole(texts) == cut(texts)


def test_merging_runs_against_counter():
    rng = np.random.default_rng(2)
    runs, want = [], Counter()
    for k in range(150):
        pairs = np.unique(rng.integers(0, 1 << 40, rng.integers(0, 300 if k % 10 else 40_000)) % (1 << 14 << (k % 3)))
        totals = rng.integers(1, 9, len(pairs))
        want.update(dict(zip(pairs.tolist(), totals.tolist())))
        runs.append(alignment._pack(pairs, totals))
    pairs, totals = alignment.folded(runs)
    assert dict(zip(pairs.tolist(), totals.tolist())) == want and (np.diff(pairs) > 0).all()
    pairs = np.array([1 << 32, (1 << 32) + 5, 2 << 32, (2 << 32) + 1, (2 << 32) + 2])
    assert alignment.best(pairs, np.array([3, 4, 2, 7, 7])).tolist() == [0, 1, 0, 1, 1]


def test_run_writer_keeps_every_record():
    rng, writer, want = np.random.default_rng(4), alignment.RunWriter(5), Counter()
    for doc in range(40):
        codes = (rng.integers(0, 9, 50).astype(np.uint64) << np.uint64(32)) | rng.integers(0, 9, 50).astype(np.uint64)
        assert writer.add(codes.tobytes() if doc % 7 else None) == doc
        want.update((doc, int(c)) for c in codes if doc % 7)
    got = Counter()
    for _, packed, held in writer.runs():
        pairs, totals = alignment._unpack(packed)
        sizes, docs, times = alignment._unpack(held)
        assert np.add.reduceat(times, np.cumsum(sizes) - sizes).tolist() == totals.tolist()
        got.update({(d, c): t for d, c, t in zip(docs.tolist(), np.repeat(pairs, sizes).tolist(), times.tolist())})
    assert got == want


def test_alignment_empty(docs):
    assert alignment.align(docs([(1, "x")]).limit(0), A_PATH, B_PATH).count() == 0
