from pyspark.sql import functions as F

from quarrylake.llm import langid

SAY = {
    "en": "the cat sat on the mat and the dog was there with that other thing which they had brought from the house",
    "de": "der hund und die katze sind nicht auf dem dach sondern unter einem großen schrank mit den anderen kindern",
    "fr": "le chien et la chatte ne sont pas sur le toit mais sous une grande armoire avec les autres enfants été où",
}


def corpus():
    out = []
    for k in range(120):
        for lang, text in SAY.items():
            words = text.split()
            out.append((len(out), " ".join(words[(k * 7 + j * (1 + k % 5)) % len(words)] for j in range(12 + k % 30)), lang))
    return out


def test_held_out_accuracy_and_odd_cases(spark):
    df = spark.createDataFrame(corpus(), "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    found = langid.learn(df.where(langid.fold() != 2))
    assert set(found) == set(SAY) and all(len(d) <= langid.DICTIONARY for d in found.values())
    held = df.where(langid.fold() == 2)
    rows = langid.identify(held, found).join(held.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) > 50 and sum(r.lang_pred == r.lang for r in rows) / len(rows) > 0.95
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "123 ... !!"), (None, "the cat and the dog"), (5, "THE CAT!! AND THE DOG!! " * 3000)], "doc_id long, text string")
    got = {r.doc_id: r for r in langid.identify(odd, found).collect()}
    assert [got[k].lang_pred for k in (1, 2, 3, None, 5)] == ["und"] * 3 + ["en"] * 2
    assert all(got[k].rejected and got[k].score == 0 for k in (1, 2, 3)) and all(0 <= r.score <= 1 for r in got.values())


def test_stage_keeps_columns_and_drops_undecided(spark):
    rows = [(i, t, g, "s", 1) for i, t, g in corpus()] + [(1000, None, "en", "s", 1), (1001, "12", None, "s", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = langid.keep_identified(df)
    ids = {r.doc_id for r in out.collect()}
    assert out.columns == df.columns and not ids & {1000, 1001} and len(ids) > 350


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert langid.learn(empty) == {} and langid.identify(empty, {}).count() == 0
    assert langid.identify(spark.createDataFrame([(1, "a")], "doc_id long, text string"), {}).first().lang_pred == "und"


def test_many_languages_and_long_texts_are_learned(spark):
    """Seventy languages, one of them only in a text far beyond a dictionary, one mostly in copies of one text."""
    rows = [(i, f"{chr(97 + i % 26)}{chr(97 + i // 26)}x " * 40 + f"word{chr(97 + i % 26)}", f"l{i:02d}") for i in range(68)]
    rows += [(100, "zu lang fur ein worterbuch aber ganz gelernt " * 20_000, "long")] + [(200 + i, "copy of one text " * 50, "copied") for i in range(400)]
    rows += [(700 + i, f"quite another text with number {chr(97 + i)} " * 30, "copied") for i in range(3)]
    found = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), dictionary=4096)
    assert len(found) == 70 and next(iter(found)) == "copied"
    assert b"gelernt" in found["long"] and len(found["long"]) > 3000
    assert b"copy of" in found["copied"] and b"quite another" in found["copied"]


def test_scores_match_the_plain_rule():
    """Brute force: each dictionary packs each block by itself, the smallest sum wins, the earlier language at ties."""
    import zstandard

    texts = [t for _, t, _ in corpus()]
    dictionaries = {g: langid.folded(t) * 20 for g, t in SAY.items()} | {"copy": langid.folded(SAY["fr"]) * 20}
    classifier = langid.Classifier(dictionaries)
    for text in texts[:60] + [texts[0] * 200]:
        folded, sizes = langid.folded(text), {}
        for lang, words in dictionaries.items():
            packer = zstandard.ZstdCompressor(level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(words, dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False, write_dict_id=False)
            sizes[lang] = sum(len(packer.compress(folded[a : a + langid.BLOCK])) for a in range(0, len(folded), langid.BLOCK))
        best = min(sizes, key=sizes.get)
        lang, score, rejected, _ = classifier.judge(text)
        assert lang == best and abs(score - 1 / sum(2.0 ** (sizes[best] - n) for n in sizes.values())) < 1e-9
        assert rejected or lang != "fr"  # its copy packs as small
