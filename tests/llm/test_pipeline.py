import random
import re

import corpus_pipeline
from reelframe.llm.bpe import codec
from reelframe.llm.queries import tokenizer_path
from tests.llm import brute
from tests.llm.test_near_dedup import expected as near_groups


def test_run_is_what_the_stages_say(spark, tmp_path):
    rng = random.Random(12)
    items = [brute.prose(rng, 20) for _ in range(5)]
    texts = [*brute.family(13, groups=5), "12 34", *(brute.prose(rng, 30) + " " + items[k] for k in range(3))]
    pairs = list(enumerate(texts))
    brute.spark_docs(spark, pairs).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")

    left = [(d, t) for d, t in pairs if t and any(map(str.isalpha, t))]
    seen = {}
    for d, t in left:
        seen.setdefault(re.sub("[\x20\x09-\x0d]+", " ", t), (d, t))
    left = list(seen.values())
    near = near_groups([t for _, t in left])
    left = [x for k, x in enumerate(left) if near[k][2]]
    for item in items:
        s = brute.shingle_set(item)
        left = [(d, t) for d, t in left if 100 * len(s & brute.shingle_set(t)) < 75 * len(s)]
    library = codec(tokenizer_path()).tokenizer
    want = {d: library.encode(t, add_special_tokens=False).ids for d, t in left}

    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "exact_dedup", "near_dedup", "decontamination", "bpe"]
    assert {r.doc_id: r.ids for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == want
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_empty_documents(spark, tmp_path):
    brute.spark_docs(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
