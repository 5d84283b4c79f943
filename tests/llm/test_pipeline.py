import zlib

import numpy as np
import pytest

from .test_decontam import brute as contaminated
from .test_neardup import brute as near
from .test_neardup import corpus


def test_pipeline_matches_brute_force(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline
    from pyspark.sql import functions as F
    from quarrylake.llm import mixing, queries, tokenfiles
    from quarrylake.llm.common import materialize
    from tokenizers import Tokenizer

    assert [name for name, _ in pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mixing", "token_output"]
    rows = [(i, t, "en" if i % 5 else None, f"s{i % 3}", len(t or "")) for i, t in corpus(60)]
    item = next(t for _, t in corpus(60) if t and len(t.split()) == 90)
    rows += [(500, None, "en", "s1", 0), (501, "12 34", "en", "s1", 5), (502, "head " + " ".join(item.split()[5:40]) + " tail", "en", "s1", 9)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    documents.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs, kept = documents, []
    for _, stage in pipeline.STAGES[:-1]:
        docs = materialize(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == documents.columns
        kept.append(docs.collect())
    mixed, kept = kept[3], [{r.doc_id: r.text for r in rows} for rows in kept]
    ids = [set(k) for k in kept]
    assert not ids[0] & {500, 501} and ids[1] == {i for i, (_, c, _) in near(list(kept[0].items()), 5).items() if i == c}
    hits = contaminated(list(kept[1].items()), [(1, item)])
    assert ids[2] == {i for i in ids[1] if not hits[i][4]} and 502 not in ids[2]
    assert ids[3] <= ids[2]
    # The mix: parts of the documents, as many words of each as the schedule takes, in the order of slots.
    before = spark.createDataFrame([(i, t, "en", f"s{i % 3}" if i < 500 else "s1", 0) for i, t in kept[2].items()], documents.schema)
    taken = {r.doc_id: (r.size, r.taken) for r in mixing.mixture(before).collect()}
    words = {}
    for r in mixed:
        words[r.doc_id] = words.get(r.doc_id, 0) + len(r.text.split())
        assert r.text.strip() in kept[2][r.doc_id] and r.n_chars == len(r.text)
    assert words == {i: n for i, (_, n) in taken.items() if n} and all(n <= 3 * size for size, n in taken.values())
    # The files: each row of the mix in the order it was written in.
    rows = docs.select("doc_id", "text", tokenfiles.file_order(docs).alias("place")).orderBy("place").collect()
    found = sorted(pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [r.doc_id for r in rows]
    library, start = Tokenizer.from_file(queries.tokenizer_path()), 0
    for r, row in zip(found, rows, strict=True):
        tokens = np.array(library.encode(row.text, add_special_tokens=False).ids + [0], "<u4")
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(tokens), zlib.crc32(tokens.tobytes()))
        start += len(tokens)
    again = pipeline.run(spark, str(tmp_path)).agg(F.count("*"), F.sum("n_tokens")).first()
    assert tuple(again) == (len(found), start)


def test_null_ids_reach_the_token_files(spark, tmp_path):
    pytest.importorskip("public_tokenizers")
    import corpus_pipeline as pipeline

    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in corpus(20)]
    rows.append((None, "a document without an id that no other document here is like", "en", "z", 60))  # all of a small source is taken three times
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = pipeline.run(spark, str(tmp_path)).collect()
    assert sum(r.doc_id is None for r in found) == 36 < len(found)  # twelve words three times, in slots of a word each
