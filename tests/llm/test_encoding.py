import pytest

from tessel.llm.encoding import find_garbled, fit_dictionaries, repair, train

SOUND = [
    "The ledger near Paris was audited by the whole floor, and “nobody” asked why — it’s fine.",
    "Nobody at the café printed a résumé until the façade turned blue; the owner’s naïve plan was late.",
    "Über Nacht wurde die Prüfung geändert, und für Müller blieb nur die Rückfrage übrig.",
    "Après la créance, le notaire préfère la procédure, même très tôt, et l’été est passé.",
    "El año pasado el camión llegó después que la selección, según señaló el notario mañana.",
    "Сначала договор, потом исковое заявление, и только весной ответил нотариус без спешки.",
    "没有法官，就无法完成判决。关于合同，随后补充了二十条意见。",
] * 60


@pytest.fixture(scope="module")
def known():
    return train([f"{i}. {t}" for i, t in enumerate(SOUND)])


def garble(text, real, view):
    return text.encode(real).decode(view, "replace")


@pytest.mark.parametrize("text,real,view", [(SOUND[0], "utf-8", "cp437"), (SOUND[2], "utf-8", "latin-1"), (SOUND[3], "utf-8", "mac_roman"), (SOUND[5], "utf-8", "cp866"), (SOUND[5], "cp1251", "latin-1"), (SOUND[5], "koi8_r", "cp1251"), (SOUND[4], "utf-8", "cp1250")])
def test_round_trip(known, text, real, view):
    found = repair(garble(text, real, view), known)
    assert found is not None and found.text == text and not found.lost


def test_twice_and_in_places(known):
    once = garble("l’été", "utf-8", "latin-1")
    text = f"Sound words — first. Then {garble(once, 'utf-8', 'latin-1')} and the owner’s plan."
    assert repair(text, known).text == "Sound words — first. Then l’été and the owner’s plan."


@pytest.mark.parametrize("text", [*SOUND[:7], None, "", "plain ASCII ? text", "The guide lists “â€™” as a sign of a wrong setting.", "dir\n├── a.txt\n└── b.txt"])
def test_sound_texts_stay(known, text):
    assert repair(text, known) is None


def test_lost_characters_are_found(known):
    found = repair("The owner�s plan was late.", known)
    assert found.lost and found.chain == []


def test_rows(spark, known):
    bad = garble(SOUND[3], "utf-8", "latin-1")
    df = spark.createDataFrame([(1, bad, "x"), (1, bad, "y"), (2, None, "z"), (3, SOUND[1], ""), (4, "é" * 50_000, "")], "chunk_id long, text string, restored string")
    out = find_garbled(df, known).collect()
    assert [(r.chunk_id, r.restored) for r in out] == [(1, SOUND[3])] * 2
    empty = df.limit(0)
    assert find_garbled(empty, fit_dictionaries(empty)).count() == 0


@pytest.mark.parametrize("text,real,view", [(SOUND[3], "utf-8", "latin-1"), (SOUND[4], "utf-8", "cp1252"), (SOUND[5], "cp1251", "cp1252")])
def test_errors_that_a_third_of_the_texts_have_are_found(text, real, view):
    bad = garble(text, real, view)
    texts = [f"{i}. {t}" for i, t in enumerate(SOUND)]
    frequent = train(texts + [f"{i}. {bad}" for i in range(len(texts) // 2)])
    found = repair(bad, frequent)
    assert found is not None and found.text == text


GREEK, JAPANESE = "Ο συμβολαιογράφος άνοιξε το φάκελο και η προσφορά έμεινε στο τραπέζι ως το βράδυ.", "公証人は書類を開き、夕方まで机の上に提案を残したままにした。"


@pytest.mark.parametrize("sound,real,view", [(GREEK, "cp1253", "cp1252"), (GREEK, "utf-8", "cp437"), (GREEK, "utf-8", "latin-1"), (JAPANESE, "cp932", "latin-1"), (JAPANESE, "utf-8", "latin-1")])
def test_languages_are_learned_from_the_texts(sound, real, view):
    known = train([f"{i}. {t}" for i, t in enumerate(SOUND + [sound] * 60)])
    bad = garble(sound, real, view)
    found = repair(bad, known)
    assert found is not None and found.text == sound and repair(sound, known) is None


def test_lost_characters_are_judged_by_their_description(known):
    assert repair("The owner’s plan was late, and nobody asked why�", known).lost
    from tessel.llm.encoding import Dictionaries

    # Where all texts have the sign, naming it costs nothing and nothing is lost by it.
    usual = Dictionaries(known.data, known.languages, {**known.naming, "�": 0.0}, known.blocks)
    assert usual.length("a �", 0) < known.length("a �", 0)


def test_every_text_is_learned_from(spark):
    from pyspark.sql import functions as F

    # Greek stands in the rows with the greatest hashes only, which no sample by the smallest ones holds.
    mark = F.pmod(F.xxhash64("chunk_id"), F.lit(1 << 30))
    keys = [r.chunk_id for r in spark.range(9000).select(F.col("id").alias("chunk_id")).orderBy(mark).collect()]
    rows = [(k, f"{k}. {SOUND[i % 7] if i < 8400 else GREEK}") for i, k in enumerate(keys)]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    known = fit_dictionaries(df)
    assert 0x3 in known.languages.blocks
    assert any("συμβολαιογράφος".encode() in content for content in known.data.values())


def test_parts_and_partitions(spark):
    rows = [(i, f"{i}. {t}") for i, t in enumerate(SOUND * 5)]
    df = spark.createDataFrame(rows, "chunk_id long, text string")
    # More parts of a cluster than are merged at once.
    one, other = (fit_dictionaries(df.repartition(n), size=2048, part=2048) for n in (2, 5))
    assert one.data == other.data and one.naming == other.naming
    assert len(one.data) == len({one.languages.of(t) for _, t in rows})
    bad = garble(SOUND[3], "utf-8", "latin-1")
    assert repair(bad, one).text == SOUND[3] and repair(SOUND[3], one) is None


def test_texts_garbled_twice_are_not_learned_from():
    bad = garble(garble(SOUND[1], "utf-8", "cp1252"), "utf-8", "cp1252")
    frequent = train([f"{i}. {t}" for i, t in enumerate(SOUND)] + [f"{i}. {bad}" for i in range(60)])
    assert repair(bad, frequent).text == SOUND[1]
    assert not any("Ã¢â‚¬".encode() in content for content in frequent.data.values())
