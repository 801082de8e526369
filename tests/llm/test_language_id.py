"""Accuracy against declarations, the posterior by hand, fusion of evidence, and edge cases."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np

from sparkloom.llm import language_id
from sparkloom.llm.language_id import corpus_languages, document_languages, keep_identified, page_languages

WORDS = {"en": "the and that with this from have which there their".split(), "de": "der die und das nicht ist mit für auf sich".split(), "fr": "les des est que une dans pour sur avec plus".split()}


def say(lang, n, rng):
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def test_documents_and_pages_agree_with_declarations(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = document_languages(docs).collect()
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    assert len(rows) == len(want) and sum(r.language == want[r.doc_id] for r in rows) > 0.98 * len(rows)
    assert sum(r.text_language == want[r.doc_id] for r in rows) > 0.95 * len(rows)
    assert sum(r.accepted for r in rows) > 0.99 * len(rows)
    pages = spark.read.parquet(f"{d}/pages.parquet")
    got = page_languages(pages).collect()
    assert len(got) == pages.count() and sum(r.accepted for r in got) > 0.95 * len(got)
    both = corpus_languages(docs, pages).collect()
    assert {r.doc_id for r in both} == {*want, None} and {r.page_id for r in both} == {*(r.page_id for r in got), None} and len(both) == len(rows) + len(got)
    assert sum(r.language == want.get(r.doc_id) for r in both if r.page_id is None) > 0.98 * len(rows)


def test_hosts_and_declarations_move_doubtful_texts_only(spark):
    rng = random.Random(6)
    rows = [(i, say(l, 60, rng), l, f"{l}{i % 3}.example.{l}") for i, l in enumerate(["en", "de", "fr"] * 100)]
    rows += [(1000, say("de", 60, rng), "en", "x.org"), (1001, "zzz", None, "de0.example.de"), (1002, "zzz", "fr", "new.example.fr"), (1003, "12 !!", "en", "en0.example.en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in document_languages(df).collect()}
    assert got[1000].language == "de" and got[1001].language == "de" and got[1002].language == "fr"
    assert got[1003].language is None and not got[1003].accepted and got[1003].confidence == 0
    assert all(got[i].language == rows[i][2] for i in range(300))


def test_cases(spark):
    schema = "doc_id long, text string, lang string, source string, declared int, n int, host string"
    empty = spark.createDataFrame([], schema)
    assert document_languages(empty).count() == 0 and keep_identified(empty).count() == 0
    rng = random.Random(7)
    good = say("en", 30, rng)
    rows = [(1, good, "en", "s", 1, 1, "h")] * 2 + [(2, None, None, None, None, None, None), (2, good, "en", None, 1, 1, "h"), (None, "", "en", "s", 1, 1, "h"), (None, say("en", 99_000, rng), "en", "s", 1, 1, "h"), (3, say("en", 9, rng), "en", "s", 1, 1, "h")]
    df = spark.createDataFrame(rows, schema)
    assert document_languages(df).count() == 7
    kept = keep_identified(df)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 1, 2, 3]
    undeclared = spark.createDataFrame([(1, good, None, "s")], "doc_id long, text string, lang string, source string")
    assert [r.accepted for r in document_languages(undeclared).collect()] == [False]


def test_rare_languages_among_many_are_learnt(spark, monkeypatch):
    """150 languages, of which one has a hundredth of the documents of the largest, and a small sample."""
    monkeypatch.setattr(language_id, "TRAIN_DOCS", 50)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    names = [f"q{a}{b}" for a in letters[:15] for b in letters[:10]]
    words = {l: ["".join(rng.choice(letters) for _ in range(5)) for _ in range(6)] for l in names}
    rows = [(l, " ".join(rng.choice(words[l]) for _ in range(40))) for k, l in enumerate(names) for _ in range(500 if k == 0 else 5 if k == 149 else 8)]
    df = spark.createDataFrame([(i, t, l, "s") for i, (l, t) in enumerate([*rows, ("qzz", "12 34")])], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r.text_language for r in document_languages(df).collect()}
    assert got.pop(len(rows)) is None and [got[i] for i in range(len(rows))] == [l for l, _ in rows]


def by_hand(rows):
    """{id: (language, posterior)} of rows (id, text, declared, host), sum by sum as the module's head has it."""
    slots, k = {i: language_id.trigrams(t).tolist() for i, t, _, _ in rows}, language_id.SLOTS
    code = {i: (m[1].lower() if (m := re.match(r"\s*([A-Za-z]{2,3})(?![A-Za-z])", d or "")) else "") for i, _, d, _ in rows}
    counts = defaultdict(Counter)
    for i in slots:
        if code[i] and slots[i]:
            counts[code[i]].update(slots[i])
    texts = Counter(code[i] for i in slots if code[i] and slots[i])
    names = sorted(l for l in counts if texts[l] >= language_id.LEAST_DOCS and counts[l].total() >= language_id.LEAST_TRIGRAMS)
    code = {i: c if c in names else "" for i, c in code.items()}
    extra = {l: 0.5 * min(1, counts[l].total() / language_id.SMOOTH_TRIGRAMS) for l in names}
    chance = {l: lambda s, l=l, n=counts[l].total() + k * extra[l]: (counts[l][s] + extra[l]) / n for l in names}
    host = {i: (h or "").lower() for i, _, _, h in rows}
    suffix = {i: (m[1] if (m := re.search(r"\.([^.:]+)(:\d+)?$", h)) else "") for i, h in host.items()}
    text, share = {}, {}
    for i, s in slots.items():
        if s:
            t = language_id.TEMPER * min(1, language_id.FULL / len(s))
            text[i] = {l: t * sum(math.log(chance[l](x)) for x in s) for l in names} | {None: t * len(s) * -math.log(k)}
            share[i] = scaled({l: v + (math.log(language_id.NOISE) if l is None else 0) for l, v in text[i].items()})
    add = lambda where: {l: sum(share[i][l] for i in share if where(i)) for l in names}
    draw = lambda sums, above: {l: (sums[l] + language_id.KAPPA * above[l]) / (sum(sums.values()) + language_id.KAPPA) for l in names}
    whole = add(lambda i: True)
    prior = {l: (whole[l] + 1) / (sum(whole.values()) + len(names)) for l in names}
    out = {}
    for i in share:
        ending = draw(add(lambda j: suffix[j] == suffix[i]), prior)
        own = draw(add(lambda j: host[j] == host[i]), ending)
        said = add(lambda j: code[j] == code[i])
        logs = {l: text[i][l] + math.log(own[l]) + (math.log((said[l] + 0.5) / (whole[l] + 1)) if code[i] else 0) for l in names}
        p = scaled(logs | {None: text[i][None] + math.log(language_id.NOISE)})
        best = max(names, key=lambda l: p[l])
        out[i] = (best, p[best])
    return out


def scaled(logs):
    top = max(logs.values())
    powers = {l: math.exp(v - top) for l, v in logs.items()}
    return {l: v / sum(powers.values()) for l, v in powers.items()}


def test_pages_equal_the_posterior_by_hand(spark):
    rng = random.Random(12)
    ends, rows = {"en": "com", "de": "de", "fr": "fr"}, []
    for i in range(90):
        l = rng.choice(["en", "de", "fr"])
        mixed = say(l, rng.randrange(1, 9), rng) + " " + say(rng.choice(["en", "de"]), rng.randrange(0, 5), rng)
        declared = rng.choice([l, l, l.upper() + "-XX", "en", None, "nonsense"])
        rows.append((i, mixed, declared, rng.choice([f"a{i % 4}.example.{ends[l]}", "hot.example.com:80", "", None])))
    noise = "".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(600))
    rows += [(900, "12 34", "en", "x.de"), (901, noise, None, "hot.example.com")]
    html = lambda t, d: (f'<html lang="{d}">' if d else "<html>") + f"<script>x</script><p>{t}</p>"
    pages = spark.createDataFrame([(i, h if h is None else f"http://{h}/p?q", html(t, d)) for i, t, d, h in rows], "page_id long, url string, html string")
    got = {r.page_id: r for r in page_languages(pages).collect()}
    want = by_hand(rows)
    assert set(got) == {r[0] for r in rows} and set(got) - set(want) == {900} and not got[900].accepted
    for i, (language, p) in want.items():
        assert got[i].language == language and abs(got[i].confidence - p) < 2e-5, i
    assert not got[901].accepted and sum(r.accepted for r in got.values()) > 80
    assert {l for l, _ in want.values()} == {"en", "de", "fr"}


def noise(rng, n):
    return " ".join("".join(rng.choice("bcdfghjklmnpqrstvwxz") for _ in range(rng.randrange(2, 9))) for _ in range(n))


def test_stray_declarations_take_in_no_noise(spark):
    """Noise is rejected whether or not a text or a few declare a language that hardly any text is in."""
    rng = random.Random(13)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", "source")
    junk = [(10_000 + i, noise(rng, 40), None, "s") for i in range(60)]
    stray = [(20_000, "ok", "zz", "s")]
    thin = [(20_001 + i, say("de", 25, rng), "zy", "s") for i in range(6)]
    for more in ([], stray, stray + thin):
        df = docs.unionByName(spark.createDataFrame(junk + more, docs.schema))
        got = {r.doc_id: r for r in document_languages(df).collect()}
        assert not any(got[i].accepted for i, *_ in junk)
        assert sum(r.accepted for i, r in got.items() if i < 10_000) >= docs.count() - 1 and all(r.language != "zz" for r in got.values())
        kept = {r.doc_id for r in keep_identified(df).select("doc_id").collect()}
        assert not kept & {i for i, *_ in junk} and len(kept) >= docs.count() - 1


def test_thousands_of_codes_make_no_larger_model(spark):
    rng = random.Random(14)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(i, say(l, 40, rng), l, "s") for i, l in enumerate(["en", "de", "fr"] * 20)]
    rows += [(1000 + i, "ok then", f"{a}{b}{c}", "s") for i, (a, b, c) in enumerate((a, b, c) for a in letters for b in letters for c in letters[:20])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    languages, table = language_id.text_model(df, "text", "lang")
    assert languages == ["de", "en", "fr"] and table.shape == (3, language_id.SLOTS)


def test_trigrams_are_counted_a_few_at_a_time():
    """Long texts are read in pieces, with the same trigrams as in one go, and none is lost between counts."""
    from sparkloom.llm import language_id as L

    text = "Der schnelle Fuchs, the lazy dog; " * 40_000
    assert all(len(p) <= L.PIECE for p in L.trigram_pieces(text))
    b = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(L.LETTERS).split()) + b" ", np.uint8).astype(np.int64)
    whole = (b[:-2] * 0x9E3B + b[1:-1] * 0x85EB + b[2:] * 0xC2B3 + (b[:-2] * b[1:-1] * b[2:] >> 3)) & (L.SLOTS - 1)
    assert (L.trigrams(text) == whole).all() and len(L.trigrams(None)) == len(L.trigrams("12 34")) == 0
    parts = list(L.counted([(0, text), (2, "ab"), (2, None)]))
    assert len(parts) > 1 and all(n.sum() <= L.HELD + L.PIECE for _, n in parts)
    total = np.zeros(3 * L.SLOTS, np.int64)
    for cell, n in parts:
        total[cell] += n
    assert (total[: L.SLOTS] == np.bincount(whole, minlength=L.SLOTS)).all() and total[L.SLOTS : 2 * L.SLOTS].sum() == 0 and total[2 * L.SLOTS :].sum() == len(L.trigrams("ab"))
