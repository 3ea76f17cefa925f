import hashlib
import random
import re
import zlib
from array import array
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
from oddloom.llm import minhash_dedup, packing, pieces, pii, secrets, substring_dedup, toxicity

from .conftest import AWKWARD

WORD, PIECE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
SPACE = re.compile(r"[\x20\x09-\x0D]+")


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def random_texts(n, seed, alphabet="ab \n.é\U0001F600'!1,▁"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 80))) for _ in range(n)]


# packing ---------------------------------------------------------------------------------

def test_word_encoder_matches_the_library():
    from tokenizers import Tokenizer

    lib, own = Tokenizer.from_file(WORD), packing.WordEncoder(WORD)
    texts = random_texts(400, 1) + ["<|endoftext|> a<|ENDOFTEXT|>", "I'LL x's İ Σας ẞ", "\x1c\x85 a. b, .. 1. é.", "ǅ ª. x" * 30]
    for text, ids in zip(texts * 2, own.encode(texts) + own.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == lib.encode(text, add_special_tokens=False).ids, text


def test_pack(docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(WORD)
    got = packing.pack(docs(AWKWARD), WORD, end_id=2, max_len=64).collect()
    assert len({r["sequence_id"] for r in got}) == len(got)
    assert all(r["length"] & (r["length"] - 1) == 0 and r["length"] <= 64 and r["offset"] == 0 for r in got)
    per = Counter()
    for r in got:
        assert zlib.crc32(np.array(r["ids"], "<u4").tobytes()) == r["ids_crc32"]
        per[r["doc_id"]] += r["length"]
    for doc_id, text in {k: v for k, v in AWKWARD}.items():
        n = len(lib.encode(text or "", add_special_tokens=False).ids) + 1
        assert per[doc_id] == n * sum(d == doc_id for d, _ in AWKWARD)
    batches = Counter()
    for r in got:
        batches[r["batch_id"]] += r["length"]
    assert max(batches.values()) <= 64
    with pytest.raises(ValueError):
        packing.pack(docs(AWKWARD), WORD, end_id=2, max_len=100)


def test_pack_empty(docs):
    assert packing.pack(docs([]), WORD, end_id=2).count() == 0


# pieces ----------------------------------------------------------------------------------

def test_pieces_match_the_library_and_span_the_text():
    import sentencepiece

    lib, own = sentencepiece.SentencePieceProcessor(model_file=PIECE), pieces.PieceEncoder(PIECE)
    texts = random_texts(600, 2) + ["  a  b▁c ﬁ １ \n x́ <s> <unk> <0x0A>", "a" * 300, " ", "▁▁ ▁"]
    for text, (ids, begins, ends) in zip(texts, own.encode(texts)):
        ids, begins, ends = (array("i", x).tolist() for x in (ids, begins, ends))
        assert ids == lib.encode(text)
        spans = [s for i, s in enumerate(zip(begins, ends)) if i == 0 or s != (begins[i - 1], ends[i - 1])]
        assert b"".join(text.encode()[a:b] for a, b in spans) == text.encode()
        assert array("i", own.encode_mapped(text)[0]).tolist() == ids


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf", "identity"])
def test_mapped_models_match_the_library(rule):
    """The same vocabulary behind a compiled character map: normalisation, alignment and ids."""
    import sentencepiece

    lib = sentencepiece.SentencePieceNormalizer(rule_name=rule)
    own = pieces.Normalizer(lib.serialized_normalizer_spec())
    texts = random_texts(300, 3, "aé́ﬁＡ①　 \x01½x") + ["", "  ", "ﬁ  Ａ é", "\x1cx \x1c"]
    for text in texts:
        normal, source = own(text)
        theirs, offsets = lib.normalize(text, with_offsets=True)
        assert (normal, [len(text.encode()[:b].decode()) for b in source]) == (theirs, offsets), text


def test_encode_frame(docs):
    got = pieces.encode(docs(AWKWARD), PIECE).collect()
    assert sorted(r["decoded"] for r in got) == sorted((t or "") for _, t in AWKWARD)
    assert pieces.encode(docs([]), PIECE).count() == 0


def test_registered_pieces_of_texts_without_any(spark, docs, tmp_path):
    """A null or empty text has no pieces and no last byte, whatever the session does on errors."""
    docs(AWKWARD).write.parquet(f"{tmp_path}/documents.parquet")
    got = contract.queries()["op8_offset_preserving_pieces"](spark, str(tmp_path)).collect()
    want = [(i, len((t or "").encode()) or None) for i, t in AWKWARD]
    assert sorted(((r["doc_id"], r["last_byte"]) for r in got), key=str) == sorted(want, key=str)
    assert all((r["n_tokens"] == 0) == (r["last_byte"] is None) for r in got)


# substring dedup -------------------------------------------------------------------------

def brute_repeats(texts, window):
    seen, split = Counter(), [words(t) for t in texts]
    for w in split:
        seen.update(tuple(w[i:i + window]) for i in range(len(w) - window + 1))
    out = []
    for w in split:
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i:i + window])] > 1:
                gone[i:i + window] = [True] * window
        out.append([x for x, g in zip(w, gone) if not g])
    return split, out


@pytest.mark.parametrize("seed", [1, 2])
def test_substring_dedup_against_brute_force(spark, docs, seed):
    rng = random.Random(seed)
    passages = [" ".join(rng.choice("abcdefghij") for _ in range(rng.randint(5, 30))) for _ in range(12)]
    rows = [(i, " ".join(rng.choice(passages) if rng.random() < 0.4 else rng.choice("klmnopqrst") for _ in range(rng.randint(0, 25))))
            for i in range(60)]
    rows += [(100 + i, t) for i, (_, t) in enumerate(AWKWARD)]
    split, kept = brute_repeats([t for _, t in rows], 8)
    got = {r["doc_id"]: r for r in substring_dedup.mark(docs(rows), window=8, seed=3).collect()}
    for (doc_id, _), own, left in zip(rows, split, kept):
        r = got[doc_id]
        assert (r["n_words"], r["n_removed"]) == (len(own), len(own) - len(left)), doc_id
        assert r["kept_sha256"] == hashlib.sha256(" ".join(left).encode()).hexdigest()
    out = substring_dedup.dedup(docs(rows), window=8, seed=3)
    assert out.columns == docs(rows).columns
    texts = {r["doc_id"]: r["text"] for r in out.collect()}
    for (doc_id, text), own, left in zip(rows, split, kept):
        assert texts[doc_id] == (text if len(own) == len(left) else " ".join(left))


def test_substring_dedup_empty(docs):
    assert substring_dedup.mark(docs([])).count() == 0


# near-duplicates -------------------------------------------------------------------------

def shingle_set(text, n):
    w = [x.lower() if x.isascii() else "".join(c.lower() if c.isascii() else c for c in x) for x in words(text)]
    return frozenset(tuple(w[i:i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)] if w else [])


def brute_components(rows, n):
    sets = [shingle_set(t, n) for _, t in rows]
    root = list(range(len(rows)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return sets, [min(rows[j][0] for j in range(len(rows)) if root[j] == root[i]) for i in range(len(rows))]


def test_near_duplicates_against_brute_force(spark, docs):
    rng = random.Random(5)
    rows = []
    for group in range(6):
        base = [f"w{rng.randint(0, 300)}" for _ in range(60)]
        for _ in range(8):
            own = list(base)
            for _ in range(rng.randint(0, 4)):
                own[rng.randrange(len(own))] = f"x{rng.randint(0, 9999)}"
            rows.append((len(rows), " ".join(own)))
    rows += [(100 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [(200, "ONE"), (201, "one Two THREE"), (202, "ONE two three")]
    sets, names = brute_components(rows, 4)
    got = {r["doc_id"]: r for r in minhash_dedup.mark(docs(rows)).collect()}
    for (doc_id, _), own, name in zip(rows, sets, names):
        assert (got[doc_id]["n_shingles"], got[doc_id]["component_id"]) == (len(own), name)
        assert got[doc_id]["kept"] == (doc_id == name)
    kept = minhash_dedup.keep_one(docs(rows), words=4)
    assert kept.columns == docs(rows).columns
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted({n for s, n in zip(sets, names) if s} | {r[0] for r, s in zip(rows, sets) if not s})


def test_near_duplicates_without_ids_or_rows(docs):
    got = minhash_dedup.mark(docs([(None, "a b c d e"), (None, "a b c d e"), (9, "a b c d e"), (9, "a b c d e")])).collect()
    assert [r["component_id"] for r in got] == [9] * 4
    assert len(minhash_dedup.keep_one(docs([(9, "a b c d e"), (9, "a b c d e"), (None, "q r s t u"), (None, "q r s t u")])).collect()) == 2
    assert minhash_dedup.mark(docs([])).count() == 0


# toxicity --------------------------------------------------------------------------------

def labelled(spark, n=300):
    rng = random.Random(4)
    plain = [f"word{i}" for i in range(60)]
    rows, labels = [], []
    for i in range(n):
        sentences = [" ".join(rng.choice(plain) for _ in range(8)) for _ in range(4)]
        bad = i % 4 == 0
        if bad:
            sentences[rng.randrange(4)] += " " + rng.choice(["vilecur", "vilecurs", "gruntling"])
        rows.append((i, ". ".join(sentences)))
        labels.append((i, int(bad)))
    return rows, labels


def test_toxicity(spark, docs):
    rows, labels = labelled(spark)
    table = spark.createDataFrame(labels + [(None, 1), (7, None), (8, 1), (8, 1)], "doc_id long, toxic int")
    model = toxicity.train(docs(rows), table)
    got = {r["doc_id"]: r for r in toxicity.score(docs(rows), model).withColumn("held", toxicity.held_out("doc_id")).collect()}
    held = [(got[i], y) for i, y in labels if got[i]["held"] and i != 8]
    assert len(held) > 30 and sum((r["score"] >= 0.5) == bool(y) for r, y in held) / len(held) > 0.95
    assert all(r["held"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    for i, y in labels[:40:4]:
        text = dict(rows)[i]
        assert any("vilecur" in text[s["start"]:s["end"]] or "gruntling" in text[s["start"]:s["end"]] for s in got[i]["sentences"])
    kept = toxicity.drop_toxic(docs(rows), table)
    assert kept.columns == docs(rows).columns and 200 < kept.count() < 235


def test_toxicity_awkward(spark, docs):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.score(docs(AWKWARD), toxicity.train(docs(AWKWARD), none)).collect()
    assert len(got) == len(AWKWARD) and all(0 <= r["score"] < 0.5 for r in got)
    assert toxicity.drop_toxic(docs(AWKWARD), none).count() == len(AWKWARD)
    assert toxicity.score(docs([]), toxicity.train(docs([]), none)).count() == 0


@pytest.mark.parametrize("known", [True, False])
def test_toxicity_of_long_clean_texts(spark, docs, known):
    rows, labels = labelled(spark)
    table = spark.createDataFrame(labels if known else [], "doc_id long, toxic int")
    rng = random.Random(6)
    clean = [s for (_, text), (_, bad) in zip(rows, labels) if not bad for s in text.split(". ")]
    longer = [(1000 + n, ". ".join(rng.choice(clean) for _ in range(n))) for n in (300, 2100, 10_000, 40_000)]
    longer += [(2000, "no. " * 50_000), (2001, "one of the words here\n" * 12_000)]
    hidden = (3000, longer[2][1] + ". word1 vilecur gruntling word2. " + longer[1][1])
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs([*longer, hidden]), toxicity.train(docs(rows), table)).collect()}
    assert all(got[i] < 0.5 for i, _ in longer), got
    assert (got[3000] >= 0.5) == known
    kept = {r["doc_id"] for r in toxicity.drop_toxic(docs([*rows, *longer, hidden]), table).collect()}
    assert {i for i, _ in longer} <= kept and (3000 in kept) != known


# personal data ---------------------------------------------------------------------------

# The rules as stated.
PII = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
       ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")]


def luhn(digits):
    return sum((c * 2 - 9 if c > 4 else c * 2) if i % 2 else c for i, c in enumerate(map(int, reversed(digits)))) % 10 == 0


def pii_base(text):
    out = []
    for n, (kind, rule) in enumerate(PII):
        for m in re.finditer(rule, text):
            d = re.sub("[^0-9]", "", m[0])
            if (kind == "email" or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                    or kind == "card" and 12 <= len(d) <= 19 and luhn(d) or kind == "phone" and 9 <= len(d) <= 15):
                out.append((m.start(), n, m.end(), kind))
    return sorted(out)


def test_pii_rules(docs):
    rng = random.Random(8)
    texts = random_texts(300, 9, "a@.b1 2-+(é\U0001F600_") + [
        "4111 1111 1111 1111 a@b.c_d@e.f.g 1.2.3.4.5.6.7.8 999.1.1.1 +1 (555) 010-9999. x@y é1.2.3.4",
        "".join(rng.choice("0123456789") for _ in range(30_000)), "1 " * 20_000, "a" * 60_000 + "@", "q@w." + "e." * 20_000, None, "",
        "4111111111111111 " * 700]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "a@b.cd"), (5, "1.2.3.4")]
    got = pii.extract(docs(rows)).collect()
    want = Counter((i, tuple(pii_base(t or ""))) for i, t in rows)
    have = Counter((r["doc_id"], tuple(tuple(s) for s in r["spans"] if s["kind"] != "context")) for r in got)
    assert have == want
    assert pii.extract(docs([])).count() == 0


def test_pii_patterns_of_found_instances_find_more(docs):
    """Seeds make "mail x"; what it finds besides makes "badge x", which no seed ever stands in, in the next turn."""
    rows = [(i, f"please mail a{i}@site.example today") for i in range(40)]
    rows += [(100 + i, f"please mail user{i}9 today") for i in range(6)]
    rows += [(200 + i, f"his badge user{i}9 shown") for i in range(6)] + [(300, "his badge other77 shown")]
    found = {}
    for turns in (1, 3):
        got = pii.extract(docs(rows), turns=turns).collect()
        found[turns] = {r["doc_id"] for r in got if any(s["kind"] == "context" for s in r["spans"])}
    assert found[1] == {*range(100, 106)} and found[3] == {*range(100, 106), *range(200, 206), 300}


def test_pii_mentions_at_the_start_and_after_another(docs):
    rows = [(1, "ab12 cd34 ends"), (2, "ext 4: ab12cd now")]
    made = {r["doc_id"]: [(m["start"], m["end"], m["word"], m["one"], m["two"], m["next"]) for m in r["m"]]
            for r in docs(rows).select("doc_id", pii.mentions(F.col("text")).alias("m")).collect()}
    assert made[1] == [(0, 4, "ab12", "^", None, "cd34"), (5, 9, "cd34", "ab12", None, "ends")]
    assert made[2] == [(4, 5, "4", "ext", "^", "ab12cd"), (7, 13, "ab12cd", "4", None, "now")]


def test_pii_patterns_find_unseen_identifiers(docs):
    rows = [(i, f"some words card number 4111{i:04d} and mail me: user{i}@mail.example now") for i in range(12)]
    rows += [(50, "text with mail me: user77(at)host7 now"), (51, "other 1999 things"), (52, "in 1999 things")]
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in pii.extract(docs(rows)).collect()}
    text = dict(rows)[50]
    assert got[50] == [("context", text.index("user77"), text.index(" now"))]
    assert got[51] == got[52] == []


# secrets ---------------------------------------------------------------------------------

# The rules as stated.
SECRETS = [("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
           ("access", r"AKIA[A-Z0-9]+"), ("hex", r"[0-9a-f]+")]


def secret_base(text):
    out = []
    for n, (kind, rule) in enumerate(SECRETS):
        for m in re.finditer(rule, text, (re.I | re.A) if kind == "assign" else 0):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((m.start(), n, kind, m.end()))
    return [(k, a, b) for a, _, k, b in sorted(out)]


def secret_rows():
    rng = random.Random(3)
    rows = []
    for i in range(120):
        plain = [rng.choice(["alpha", "beta", "gamma", "delta", "token", "Omega,", "2024", "v1.2"]) for _ in range(30)]
        if i % 3 == 0:
            key = "".join(rng.choice("0123456789abcdef") for _ in range(40))
            plain[rng.randrange(30)] = rng.choice([f'token = "{key}"', f"API_KEY:{key}", key, "AKIA" + key.upper()[:20].replace("_", "X")])
        rows.append((i, " ".join(plain[:15]) + "\n" + " ".join(plain[15:])))
    return rows


def test_secret_rules_and_field(docs):
    rows = secret_rows() + [(900 + i, t) for i, (_, t) in enumerate(AWKWARD)] + [
        (800, "paſſword = secretly passwd: abc TOKEN='abcdef' AKIA" + "A" * 15 + " " + "f" * 23 + " " + "0" * 24),
        (801, "alpha\n" + "ab12cd34" * 9 + "X beta")]
    field = secrets.train(docs(rows))
    got = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.find(docs(rows), field).collect()}
    for doc_id, text in rows:
        assert [s for s in got[doc_id] if s[0] != "crf"] == secret_base(text or ""), doc_id
    tagger = secrets.Tagger(field)
    hits = [(t, [s for s in secrets.rules(t)]) for _, t in secret_rows() if secrets.rules(t)]
    found = sum(any(a < s[4] and s[3] < b for a, b in tagger.spans(t)) for t, own in hits for s in own)
    assert found / sum(len(own) for _, own in hits) > 0.95  # the field learns what the rules show it
    clean = secrets.redact(docs(rows), field)
    assert clean.columns == docs(rows).columns
    texts = {r["doc_id"]: r["text"] for r in clean.collect()}
    assert not any(secret_base(t or "") for t in texts.values() if t and "[SECRET]" in t)
    assert texts[901 - 1] is None and all(texts[i] == t for i, t in rows if not got[i])


def test_viterbi_skips_only_lines_without_secrets():
    """Pruned decoding gives the tags of decoding every line."""
    rng = np.random.default_rng(2)
    field = secrets.Field(rng.normal(size=(secrets.BUCKETS, 3)) * 0.6, rng.normal(size=(5, 3)), rng.normal(size=(3, 3)),
                          frozenset(["alpha", "beta"]))
    field.steps[secrets.O, secrets.I] = secrets.OFF
    field.weights[:, 0] += 0.25
    rnd = random.Random(2)
    tagger = secrets.Tagger(field)
    lines = [[rnd.choice(["alpha", "beta", "x9", "Zz1=", "ffff0000aaaa1", "q,"]) for _ in range(rnd.randint(0, 12))] for _ in range(60)]
    whole, seen = secrets.Tagger(field), {}
    original = np.nonzero
    try:  # a bound that never prunes
        secrets.np.nonzero = lambda x: (np.arange(len(x)),)
        seen = whole.tags(lines)
    finally:
        secrets.np.nonzero = original
    assert tagger.tags(lines) == seen and seen


def test_secrets_without_matches(docs):
    rows = [(1, "nothing here"), (2, None)]
    field = secrets.train(docs(rows))
    assert field is None and all(r["spans"] == [] for r in secrets.find(docs(rows), field).collect())
    assert secrets.find(docs([]), secrets.train(docs([]))).filter(F.size("spans") > 0).count() == 0


# groups of near copies that only one text links ------------------------------------------

@pytest.mark.parametrize("tile", [minhash_dedup.TILE, 50])
def test_near_copies_of_one_text(docs, monkeypatch, tile):
    """Copies with one other word each: all are linked with the original, none with each other."""
    monkeypatch.setattr(minhash_dedup, "TILE", tile)
    base = [f"w{i}" for i in range(60)]
    rows = [(5000, " ".join(base))]
    for i in range(1500):
        own = list(base)
        own[8 + i % 44] = f"x{i}"
        rows.append((i + (i >= 700) * 9000, " ".join(own)))
    rows += [(20_000 + i, " ".join(f"y{i}-{k % 30}" for k in range(40))) for i in range(40)]
    got = minhash_dedup.mark(docs(rows)).collect()
    assert {r["component_id"] for r in got if r["doc_id"] < 20_000} == {0}
    assert all(r["kept"] for r in got if r["doc_id"] >= 20_000)


def test_blocks_bring_any_two_members_together(spark, monkeypatch):
    monkeypatch.setattr(minhash_dedup, "TILE", 4)
    apart = spark.range(60).select((F.col("id") % 2).alias("bucket"), F.col("id").alias("cid"), F.col("id").alias("root"))
    met = Counter()
    blocks = {}
    for r in minhash_dedup._blocks(apart).collect():
        blocks.setdefault((r["bucket"], r["i"], r["j"]), []).append((r["tile"], r["cid"]))
    for (_, i, j), members in blocks.items():
        met.update((a, b) for s, a in members for t, b in members if a < b and (i == j or s != t))
    assert met == Counter((a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2)


# the field's decoding, the noisy-or ------------------------------------------------------

def test_viterbi_against_enumeration():
    import itertools

    rng = np.random.default_rng(3)
    for n in (1, 2, 5):
        for _ in range(40):
            steps = rng.normal(size=(3, 3)) + np.where(np.array([[1, 1, 0], [1, 1, 1], [1, 1, 1]]) > 0, 0.0, secrets.OFF)
            field = secrets.Field(np.zeros((secrets.BUCKETS, 3)), np.zeros((5, 3)), steps, frozenset())
            emit = rng.normal(size=(n, 3)) * 2

            def worth(path):
                start = secrets.OFF if path[0] == secrets.I else 0
                return start + sum(emit[i, t] for i, t in enumerate(path)) + sum(steps[a, b] for a, b in zip(path, path[1:]))

            got = secrets.Tagger(field).viterbi(emit.tolist())
            assert worth(got) == pytest.approx(max(map(worth, itertools.product(range(3), repeat=n))))


def test_every_secret_of_a_line_is_an_example():
    keys = [f"password={i:02}abcdefgh" for i in range(30)]
    made = secrets._examples([" ".join(w for k in keys for w in [k, *["und"] * 9])])
    tagged = {w for words, tags, _ in made for w, t in zip(words, tags) if t}
    assert tagged == set(keys)


def test_noisy_or_against_its_formula():
    scorer = toxicity.Scorer(toxicity.Model(np.zeros(toxicity.BUCKETS), -4.0, 0.01, 0.02))
    p0 = 1 / (1 + np.exp(4.0))
    rng = random.Random(4)
    for _ in range(200):
        own = [rng.choice([p0, p0 / 2, 0.03, 0.2, 0.5, 0.9]) for _ in range(rng.randint(0, 60))]
        evidence = [1 - (1 - p) / (1 - p0) for p in own if p > p0]
        keep = np.prod([1 - e for p, e in zip([p for p in own if p > p0], evidence) if p >= toxicity.STRONG] or [1.0])
        weak = -sum(np.log(1 - e) for p, e in zip([p for p in own if p > p0], evidence) if p < toxicity.STRONG)
        weak = max(weak - len(own) * 0.01 - toxicity.BEYOND * 0.02 * len(own) ** 0.5, 0)
        want = max([1 - (1 - p0) * keep * np.exp(-weak), p0, *own])
        assert scorer.document([(0, 1, p) for p in own]) == pytest.approx(want)
