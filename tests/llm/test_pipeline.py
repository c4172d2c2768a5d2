import random

import corpus_pipeline
from arbolex.llm import decontamination, langid, packing, pii, queries, simhash

from .fixtures import prose
from .test_models import plain_components, plain_print
from .test_spans import ITEM, plain_spans


def documents(spark, path):
    rng = random.Random(3)
    texts = [prose(rng, rng.randint(30, 120)) for _ in range(60)]
    long = prose(rng, 1500)
    texts += [texts[1], texts[1], long, long.replace(" ", "  ", 1), f"{texts[3]} {ITEM} {texts[4]}", texts[5] + " mail me@here.org", None, "", "12 34", texts[7] + " 1.2.3.4"]
    rows = [(k, t, "en" if k % 9 else None, "s", len(t or "")) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return texts


def test_stages_against_brute_force(spark, tmp_path):
    texts = documents(spark, tmp_path)
    assert [k for k, _ in corpus_pipeline.STAGES] == ["language", "near_dedup", "decontaminate", "redact", "pack"]
    kept = {k: t for k, t in enumerate(texts) if t and any(c.isalpha() for c in t)}
    group = plain_components({k: plain_print(t) for k, t in kept.items()})
    kept = {k: t for k, t in kept.items() if group[k] == k and ITEM not in t}
    for k, t in kept.items():
        for kind, start, end in sorted((s.split(":") for s in plain_spans(t)), key=lambda s: -int(s[1])):
            t = t[: int(start)] + f"<{kind.upper()}>" + t[int(end) :]
        kept[k] = t
    plain = packing._plain(packing._path(packing.VOCABULARY))
    want = {k: len(plain.encode(t, add_special_tokens=False).ids) + 1 for k, t in kept.items()}
    got = {}
    for r in queries.QUERIES["pipeline"](spark, str(tmp_path)).collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + r["length"]
    assert got == want


def test_stages_keep_columns_and_repeats(spark, tmp_path):
    documents(spark, tmp_path)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    twice = docs.unionByName(docs.where("doc_id < 5"))
    for f in (langid.determined, simhash.deduplicated, pii.redacted):
        assert f(twice).columns == docs.columns
        assert f(docs.where("doc_id < 0")).count() == 0
    assert simhash.deduplicated(twice).count() == simhash.deduplicated(docs).count()
    assert decontamination.decontaminated(twice, spark.read.parquet(f"{tmp_path}/benchmark.parquet")).count() == twice.count() - 1
