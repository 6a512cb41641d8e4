"""The corpus operators on small tables with nulls, ties, repeats, clashing columns and no rows."""

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long, _id string, label string"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "clash", "clash") for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def hard(spark):
    base = " ".join(f"w{k}" for k in range(80))
    rows = [(1, None, None), (2, "", "a"), (3, "Same line\nother 3", "a"), (4, " same LINE \nother 4", "a"), (5, base, "b"), (5, base, "b"), (6, base.replace("w40 ", "zz "), "b"), (None, base, "a"), (7, "x " * 30000, "b"), (8, "a b", "b"), (9, "a b", "b")]
    return docs_of(spark, rows)


def test_line_dedup(spark, hard):
    from quadrille.llm.line_dedup import dedup_lines

    out = {(r.doc_id, r.text): r for r in dedup_lines(hard, min_docs=2).collect()}
    r = out[(4, " same LINE \nother 4")]
    assert (r.kept_text, r.n_lines, r.n_dropped) == ("other 4", 2, 1) and r._id == "clash"
    assert (out[(1, None)].kept_text, out[(1, None)].n_lines, out[(1, None)].n_dropped) == ("", 1, 0)
    assert dedup_lines(hard.limit(0)).count() == 0 and dedup_lines(hard).count() == 11


def test_sharding(spark, hard):
    from quadrille.llm.sharding import interleave

    many = docs_of(spark, [(k, f"t{k}", "hot" if k % 3 else f"s{k % 7}") for k in range(1000)])
    rows = interleave(many, shards=8).collect()
    sizes = [sum(r.shard == s for r in rows) for s in range(8)]
    assert max(sizes) - min(sizes) <= 1
    for s in range(8):
        assert sorted(r.slot for r in rows if r.shard == s) == list(range(sizes[s]))
        assert abs(sum(r.shard == s and r.source == "hot" for r in rows) - 666 / 8) <= 8
    rows = interleave(hard).collect()
    assert len(rows) == 11 and {(r["size"], r.text_crc32) for r in rows if r.doc_id == 1} == {(1, 0)}
    assert interleave(hard.limit(0)).count() == 0


def test_url_reputation(spark):
    from quadrille.llm.url_reputation import judge_urls

    urls = [None, "nothing", "HTTP://A.Example.ORG/es/x?q", "http://example.org/en/12", "http://b.com/fr/1", "http://com/de/1", "http://spam.net?x/y", "http://good.net/a#/b", "http://xorg/"]
    pages = spark.createDataFrame([(k, u, "%%%" * 9 if u and "spam" in u else None if k == 1 else "<p>fine</p>", "z") for k, u in enumerate(urls * 3)], "page_id long, url string, html string, host string")
    out = {r.page_id: r for r in judge_urls(pages).collect()}
    assert len(out) == 27
    assert [(out[k].host, out[k].path, out[k].rule) for k in range(9)] == [
        ("", "", None), ("", "", None), ("a.example.org", "/es/x", "example.org/es/"), ("example.org", "/en/12", "example.org/en/1"), ("b.com", "/fr/1", "com/fr/"), ("com", "/de/1", "com/de/"), ("spam.net", "", None), ("good.net", "/a", None), ("xorg", "/", None),
    ]
    assert [out[k].verdict for k in (2, 3, 4, 5, 6)] == ["block", "block", "allow", "block", "block"]
    assert judge_urls(pages.limit(0)).count() == 0


def test_chat(spark):
    from quadrille.llm.chat import digest_examples, format_conversations

    said = [(-7, 0, "user", r"\### Assistant: </turn> ok"), (-7, 1, "assistant", r"\### Assistant: </turn> ok"), (1, 2, "assistant", "two"), (1, 0, "user", None), (1, 1, "assistant", "one"), (1, 3, None, "end"), (2, 0, "user", "alone"), (None, None, "assistant", "")]
    rows = spark.createDataFrame(said, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in digest_examples(format_conversations(rows)).collect()}
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out[1].n_turns == 4 and out[1].loss_sha256 == sha("onetwo") and out[1].loss_chars == 6 and out[1].n_examples == 3
    assert out[1].turns_sha256 == sha("user\n\nassistant\none\nassistant\ntwo\n\nend\n")
    assert out[2].loss_sha256 == sha("") and out[-7].loss_sha256 == sha(said[0][3])
    assert format_conversations(rows.limit(0)).count() == 0


def test_media_and_bpe(spark, hard):
    import public_tokenizers

    from quadrille.llm.bpe import encode_documents
    from quadrille.llm.media import clip_rows, media_digests, store

    out = media_digests(hard).collect()
    assert len(out) == 11 and all(r.payload_bytes % 576 == 0 and r.payload_bytes > 0 for r in out)
    assert {r.tail_crc32 for r in out if r.doc_id == 2} == {zlib.crc32(b"\xff" * 32)}
    clips = clip_rows(spark.createDataFrame([(1, bytearray(store("abc")[1]))], "doc_id long, media binary")).collect()
    assert [(c.start_frame, c.end_frame) for c in clips] == [(0, 1)]
    path = public_tokenizers.path("word_bpe_49k.json")
    assert {r.doc_id: r.n_tokens for r in encode_documents(hard, path).collect()}[2] == 0
    assert encode_documents(hard.limit(0), path).count() == 0 and media_digests(hard.limit(0)).count() == 0


def test_ngram_join(spark, hard):
    from quadrille.llm.ngram_join import near_groups

    out = sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in near_groups(hard).collect())
    assert out == [(-1, 76, 5), (1, 0, 1), (2, 0, 2), (3, 1, 3), (4, 1, 4), (5, 76, 5), (5, 76, 5), (6, 76, 5), (7, 1, 7), (8, 1, 8), (9, 1, 8)]
    assert near_groups(hard.limit(0)).count() == 0


def groups_of_all_pairs(texts):
    from quadrille.llm.ngram_join import _linked, shingles

    group, sets = list(range(len(texts))), [shingles(t) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if _linked(sets[i], sets[j])]
    while any(group[i] != group[j] for i, j in links):
        for i, j in links:
            group[i] = group[j] = min(group[i], group[j])
    return group


def test_ngram_join_finds_links_across_stars(spark):
    """Random families of near copies, against all pairs."""
    import random

    from quadrille.llm.ngram_join import near_groups

    r = random.Random(4)
    texts = []
    for f in range(6):
        base = [f"f{f}w{k}" for k in range(60)]
        for _ in range(9):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(60)] = f"n{r.random()}"
            texts.append(" ".join(w[: r.randint(48, 60)]))
    out = {x.doc_id: x.component_id for x in near_groups(docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert [out[k] for k in range(len(texts))] == groups_of_all_pairs(texts)


@pytest.mark.parametrize("few", [2, 32])
def test_ngram_join_of_hot_shingles(spark, monkeypatch, few):
    """A large family whose outer members link with few or none, chains of edits, and a passage in 30% of the documents."""
    import random

    from quadrille.llm import ngram_join
    from quadrille.llm.ngram_join import near_groups

    monkeypatch.setattr(ngram_join, "FEW", few)

    r = random.Random(9)
    texts, base, passage = [], [f"b{k}" for k in range(80)], [f"p{k}" for k in range(70)]
    for k in range(150):
        w = list(base)
        for _ in range(r.choice((0, 1, 2, 3, 4, 5, 6, 8))):
            w[r.randrange(80)] = f"n{r.random()}"
        texts.append(" ".join(w[r.randint(0, 6) : r.randint(70, 80)]))
    chain = list(base)
    for k in range(30):  # each links with the one before, the last with nothing of the family
        chain[(k * 7) % 80] = f"chain{k}"
        texts.append(" ".join(chain))
    for k in range(120):
        own = [f"o{k % 17 if k % 3 else k}x{j}" for j in range(r.randint(4, 40))]
        texts.append(" ".join([*own, *passage, *(f"t{r.random()}" for _ in range(r.randint(0, 5)))]))
    texts += [" ".join(f"a{k}x{j}" for j in range(60)) for k in range(100)]
    order = list(range(len(texts)))
    r.shuffle(order)
    texts = [texts[k] for k in order]
    out = {x.doc_id: x.component_id for x in near_groups(docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)])).collect()}
    assert [out[k] for k in range(len(texts))] == groups_of_all_pairs(texts)


def test_ngram_join_of_groups(spark, monkeypatch):
    """The members of a large family give few rows each, and the same groups as by keys of differences."""
    import random

    from quadrille.llm import ngram_join

    r = random.Random(5)
    texts, base = [], [f"b{k}" for k in range(80)]
    for k in range(160):
        w = list(base)
        for _ in range(r.choice((0, 2, 4, 6, 8, 9))):
            w[r.randrange(80)] = f"n{r.random()}"
        texts.append(" ".join(w[r.randint(0, 6) : r.randint(70, 80)]))
    docs, made, write = docs_of(spark, [(k, t, "a") for k, t in enumerate(texts)]), {}, ngram_join.materialise

    def counted(df, name):
        out = write(df, name)
        if name in ("groups", "differences", "keyed"):
            made[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "materialise", counted)
    expected = groups_of_all_pairs(texts)
    out = {x.doc_id: x.component_id for x in ngram_join.near_groups(docs).collect()}
    assert [out[k] for k in range(len(texts))] == expected
    assert made["groups"] >= 100 and made["differences"] <= 2 * made["groups"] and made["keyed"] == 0
    for most in (0, 40):  # larger groups by keys, or some so and some whole
        monkeypatch.setattr(ngram_join, "MOST_MEMBERS", most)
        out = {x.doc_id: x.component_id for x in ngram_join.near_groups(docs).collect()}
        assert [out[k] for k in range(len(texts))] == expected
    assert made["keyed"] > 0


def test_decontamination(spark, hard):
    from quadrille.llm.decontaminate import find_leaks

    item = " ".join(f"q{k}" for k in range(30))
    changed = " ".join("other" if k % 8 == 3 else f"q{k}" for k in range(30))
    noise = " ".join(f"n{k}" for k in range(100))
    rows = docs_of(spark, [(11, f"{noise} {item} {noise}", "a"), (12, f"{noise} {changed} {noise}", "a"), (13, noise, "a"), (14, None, "a"), (15, " ".join(item.split()[:9]) + noise, "a")])
    items = spark.createDataFrame([(1, item), (2, None), (3, "")], "item_id long, text string")
    assert sorted((r.doc_id, r.item_id) for r in find_leaks(rows, items).collect()) == [(11, 1), (12, 1)]
    assert find_leaks(rows, items.limit(0)).count() == 0 and find_leaks(hard.limit(0), items).count() == 0


def test_toxicity(spark):
    from quadrille.llm.toxicity import score_documents, train

    rows = docs_of(spark, [(k, f"A calm sentence number{k}. " + ("You are scum today. " if k % 3 == 0 else "") + "The end.", "a") for k in range(300)] + [(None, None, None)])
    labels = spark.createDataFrame([(k, 1, int(k % 3 == 0), "x") for k in range(300)] + [(None, 1, 1, "x"), (5, 0, None, "x")], "doc_id long, quality int, toxic int, text string")
    model = train(rows, labels)
    out = {r.doc_id: r.score for r in score_documents(rows, model).collect()}
    assert all((out[k] >= 0.3) == (k % 3 == 0) for k in range(300)) and out[None] < 0.3
    assert score_documents(rows, model, keep_below=0.3).columns == rows.columns
    none = train(rows, labels.filter("toxic = 9"))
    assert 0 <= score_documents(rows, none).agg(F.max("score")).first()[0] <= 1


def test_license_scan(spark, hard):
    from quadrille.llm.license_scan import scan_licenses

    rows = docs_of(spark, [(1, "x " * 2000 + "Licensed under CC BY-NC 4.0.\nLicensed under the Apache Licence, Version 2.0.", "a")])
    assert {r.license for r in scan_licenses(rows).collect()} == {"CC-BY-NC-4.0", "Apache-2.0"}
    assert scan_licenses(hard).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    texts = [f"Text number{k} " + " ".join(f"w{k}x{j}" for j in range(40)) + ("\nYou scum." if k % 5 == 0 else "\nshared line") for k in range(60)]
    rows = spark.createDataFrame([(k, t, "en", "s", len(t)) for k, t in enumerate(texts)] + [(60, texts[1], "en", "s", 1), (61, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    rows.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(k, 1, int(k % 5 == 0)) for k in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, " ".join(f"w7x{j}" for j in range(30)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = {r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert kept == {k for k in range(60) if k % 5 and k != 7} | {61}


def test_decontamination_paraphrase(spark):
    """A copy that keeps three quarters of the words, but few of the rare ones."""
    from quadrille.llm.decontaminate import find_leaks

    common = [f"c{k}" for k in range(60)]
    docs = [(k, " ".join(common[(k * 7 + j * (1 + k % 5)) % 60] for j in range(200))) for k in range(100)]
    item = [w for k in range(13) for w in (f"rare{k}", common[k])] + ["end", "c59"]  # 28 words
    changed = [f"other{k}" if k < 14 and k % 2 == 0 else w for k, w in enumerate(item)]  # 7 rare ones
    again = [f"more{k}" if k < 16 and k % 2 == 0 else w for k, w in enumerate(item)]  # 8: too many
    rows = docs + [(k, " ".join(common[20:50] + copy + common[15:45])) for k, copy in ((200, item), (201, changed), (202, again))]
    found = find_leaks(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, " ".join(item))], "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.lcs) for r in found) == [(200, 1.0), (201, 0.75)]


def test_line_dedup_counts_documents(spark):
    """At the threshold of 10, documents count as in OP2_SQL: repeated rows once, rows without a doc_id not at all."""
    from quadrille.llm.line_dedup import dedup_lines

    rows = [(k, "twice") for k in range(5)] * 2 + [(None, "nobody's")] * 10 + [(k, "ten") for k in range(10, 20)] + [(k, "nine") for k in range(20, 29)] * 2
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows) and {r.text: r.n_dropped for r in out} == {"twice": 0, "nobody's": 0, "ten": 1, "nine": 0}


def test_pipeline_without_labels(spark, hard, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.toxicity(spark, hard, str(tmp_path)).count() == hard.count()


def test_clashing_names(spark, tmp_path):
    """Columns named like those that operators and stages make."""
    import corpus_pipeline
    from quadrille.llm.line_dedup import dedup_lines

    line = "the same line"
    rows = spark.createDataFrame([(k, f"{line}\nown {k} " + " ".join(f"w{k}x{j}" for j in range(20)), "en", "s", 1, "a", 2, "b", 3) for k in range(12)], "doc_id long, text string, lang string, source string, n_chars long, kept_text string, n_lines int, _of string, component_id int")
    out = dedup_lines(rows)
    assert sorted(out.columns) == sorted([*rows.columns, "n_dropped"]) and {(r.n_lines, r.n_dropped) for r in out.collect()} == {(2, 1)}
    spark.createDataFrame([(1, " ".join(f"w7x{j}" for j in range(20)))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = corpus_pipeline.line_dedup(spark, rows, str(tmp_path))
    assert kept.columns == rows.columns and {(r.kept_text, r.n_lines, line in r.text) for r in kept.collect()} == {("a", 2, False)}
    assert corpus_pipeline.jaccard_join(spark, rows, str(tmp_path)).count() == 12
    left = corpus_pipeline.decontamination(spark, rows, str(tmp_path))
    assert left.columns == rows.columns and {r.doc_id for r in left.collect()} == set(range(12)) - {7}
    assert corpus_pipeline.jaccard_join(spark, rows.limit(0), str(tmp_path)).count() == 0


def test_contradictory_labels(spark):
    """A document labelled both ways counts as toxic, whatever the order of the rows."""
    from quadrille.llm.toxicity import score_documents, train

    rows = docs_of(spark, [(k, f"A calm sentence number{k}. " + ("You are scum today. " if k % 3 == 0 else "") + "The end.", "a") for k in range(240)])
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(240)] + [(k, 0) for k in range(0, 240, 3)], "doc_id long, toxic int")
    models = [train(rows, t) for t in (labels, labels.orderBy(F.desc("doc_id"), "toxic"))]
    assert models[0].weights.keys() == models[1].weights.keys() and len(models[0].weights) > 0
    out = {r.doc_id: r.score for r in score_documents(rows, models[0]).collect()}
    assert all((out[k] >= 0.3) == (k % 3 == 0) for k in range(240))
