"""The stages of the corpus pipeline against brute force on a planted corpus."""

import random

import corpus_pipeline
from test_decontaminate import brute as hits
from test_simhash import plain_components, plain_fingerprint

WORDS = {"en": "the and that with this from have which there their house garden river".split(), "de": "der die und das nicht ist mit für auf sich haus garten fluss".split()}


def corpus(rng):
    say = lambda l, n: " ".join(rng.choice(WORDS[l]) + rng.choice("abcdefgh") for _ in range(n))
    rows = [(i, say(l := ("en" if i % 3 else "de"), 80), l, f"s{i % 4 if i < 60 else 0}") for i in range(120)]
    items = [(k, say("en", 30)) for k in range(3)]
    rows += [(200 + i, rows[i][1], rows[i][2], rows[i][3]) for i in range(10)] + [(220, rows[5][1] + " x", "en", "s1"), (221, "12345 !!", "en", "s0"), (222, None, None, None)]
    rows += [(230 + k, rows[k + 40][1] + " " + t + " " + say("en", 20), "en", "s2") for k, (_, t) in enumerate(items)]
    return [(*r, len(r[1] or "")) for r in rows], items


def test_stages(spark, tmp_path):
    rows, items = corpus(random.Random(8))
    d = f"{tmp_path}/sf"
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    seen = {None: spark.read.parquet(f"{d}/documents.parquet")}
    for name, stage in corpus_pipeline.STAGES:
        last = list(seen)[-1]
        out = stage(spark, seen[last], d)
        path = f"{tmp_path}/{name}"
        out.write.parquet(path)
        seen[name] = spark.read.parquet(path)
        assert out.columns == docs.columns + (["shard"] if name == "shards" else [])
    ids = {k: sorted(r.doc_id for r in v.collect()) for k, v in seen.items()}
    text = {r[0]: r[1] for r in rows}
    assert set(ids[None]) - set(ids["language"]) == {221, 222}
    kept = ids["language"]
    assert ids["near_duplicates"] == sorted(set(plain_components(kept, [plain_fingerprint(text[i]) for i in kept]).values()))
    assert ids["decontaminate"] == [i for i in ids["near_duplicates"] if not hits(text[i], items)[4]]
    assert set(ids["mix"]) == set(ids["decontaminate"]) and max(map(ids["mix"].count, set(ids["mix"]))) == 2
    assert ids["shards"] == ids["mix"]
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, d).collect()) == ids["mix"]
