"""The stages on a small fixture, each against what it stands for."""

import corpus_pipeline
from tallyguard.llm import jaccard, toxicity

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_stages(spark, tmp_path):
    words = [f"word{i}" for i in range(60)]
    rows = [
        (0, " ".join(words), "en", "a", 1),
        (1, " ".join(words), "en", "b", 1),
        (2, " ".join([*words, "more"]), "en", "a", 1),
        (3, "you are an idiot and a moron", "en", "a", 1),
        (4, "write to joe@mail.example or +49 30 1234567 please now", "en", "b", 1),
        (5, None, None, None, None),
        (6, "quite another text of some ten words to be kept", "en", "c", 1),
    ]
    docs = spark.createDataFrame(rows, COLUMNS)
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(6, 1, None)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        seen = stage(spark, seen, str(tmp_path))
        assert seen.dtypes == docs.dtypes, name
        ids = sorted({r.doc_id for r in seen.select("doc_id").collect()})
        if name == "toxicity":
            assert ids == [0, 1, 2, 4, 5, 6]
        elif name == "jaccard":
            assert ids == [0, 4, 5, 6]
        elif name == "pii":
            assert seen.where("doc_id = 4").first().text == "write to <EMAIL> or <PHONE> please now"
        else:
            words_out = {s: 0 for s in "abc"}
            for r in seen.collect():
                words_out[r.source] = words_out.get(r.source, 0) + len((r.text or "").split())
            total = 60 + 7 + 10
            assert abs(sum(words_out.values()) - total) <= 3 and words_out["b"] <= 21 and words_out["c"] <= 30
    packed = corpus_pipeline.run(spark, str(tmp_path))
    assert packed.agg({"length": "sum"}).first()[0] > 0


def test_names_are_of_the_operators():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "jaccard", "pii", "mixing", "packing"]
    assert jaccard.THRESHOLD == 0.8 and jaccard.N_WORDS == 5 and toxicity.MARKS[0] == "insult"


def brute_classes(texts):
    """Places of each class of texts linked by a similarity of 0.8 over five-word runs."""
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for t in texts]
    root = list(range(len(texts)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]):
                root[max(top(i), top(j))] = min(top(i), top(j))
    return [top(i) for i in range(len(texts))]


def test_stages_by_brute_force_on_the_table(spark):
    """Every stage on the smallest table against a plain loop over what the stage before kept; an odd column comes along."""
    from pyspark.sql import functions as F

    from tallyguard.llm import mixing, packing, pii, toxicity

    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("a.b", F.lit("x"))
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    stages = dict(corpus_pipeline.STAGES)

    rows = docs.collect()
    model = toxicity.fit(docs, labels)
    scorer = toxicity.Scorer(model.insults, model.weights)
    left = [r for r in rows if scorer.score(r.text) < 0.5]
    found = stages["toxicity"](spark, docs, sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, left)) and found.columns == docs.columns

    left.sort(key=lambda r: r.doc_id)
    classes = brute_classes([r.text for r in left])
    firsts = [r for i, r in enumerate(left) if classes[i] == i]
    found = stages["jaccard"](spark, spark.createDataFrame(left, docs.schema), sf_dir)
    assert sorted(map(str, found.collect())) == sorted(map(str, firsts)) and len(firsts) < len(left)

    automaton = pii.anchors()
    clean = []
    for r in firsts:
        spans = pii.find(r.text or "", automaton)
        text = r.text
        for _, at, end in sorted(spans, key=lambda s: -s[1]):
            assert text is not None and at < end <= len(r.text)
        clean.append((r.doc_id, pii.redact(r.text, spans) if spans else r.text))
    found = stages["pii"](spark, spark.createDataFrame(firsts, docs.schema), sf_dir)
    assert sorted((r.doc_id, r.text) for r in found.collect()) == sorted(clean)
    redacted = found.collect()

    size = lambda t: len((t or "").split())
    mixed = stages["mixing"](spark, spark.createDataFrame(redacted, docs.schema), sf_dir)
    taken = {r.doc_id: r.taken for r in mixing.mix(spark.createDataFrame(redacted, docs.schema)).collect()}
    words, text_of = {}, {r.doc_id: r.text or "" for r in redacted}
    mixed_rows = mixed.collect()
    for r in mixed_rows:
        words[r.doc_id] = words.get(r.doc_id, 0) + size(r.text)
        assert text_of[r.doc_id].startswith(r.text or "")
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}

    packed = stages["packing"](spark, spark.createDataFrame(mixed_rows, docs.schema), sf_dir).collect()
    encode = packing.Encoder(packing.tokenizer_paths()[0])
    assert sum(r.length for r in packed) == sum(len(encode(r.text or "")) + 1 for r in mixed_rows)
