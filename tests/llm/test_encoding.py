import numpy as np
import pytest

from docloom.llm import encoding

RU = ["Когда терминал не отвечает, оператор открывает складской журнал и проверяет каждый заказ.", "Начиная с версии сервис отправляет отчёт в общий архив, после этого пишет владельцу."]
FR = ["La tâche est arrêtée à la fin du créneau, le relevé n’est pas complété où le réseau répond.", "Après l’arrêt forcé, la clé désigne une pièce reçue à côté de l’étagère déclarée."]
EN = ["The service isn’t allowed to change the “frozen dashboard” — ask the owner first.", "Plain ascii text about a pallet index and a worker pool."]
GARBLES = [("utf-8", "cp1251"), ("utf-8", "cp1252"), ("cp1251", "cp1252"), ("cp866", "cp1251"), ("koi8_r", "cp1251"), ("utf-8", "cp866"), ("iso8859_5", "cp1251")]


def garble(text, written, read):
    table = encoding._tables()[read]
    return "".join(chr(table[b]) for b in text.encode(written, "replace"))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(4)
    words = {k: " ".join(t).split() for k, t in (("ru", RU), ("fr", FR), ("en", EN))}
    sound = []
    for _ in range(600):
        own = words[rng.choice(["ru", "fr", "en"])]
        at = rng.integers(0, len(own), 3)
        sound.append(". ".join(" ".join(own[a : a + 9]) for a in at))
    return sound


@pytest.fixture(scope="module")
def restorer(texts):
    size = encoding.alphabet()[1]
    counts = np.zeros(size * size)
    garbled = [garble(RU[0], *GARBLES[0])]
    i = encoding._indices(encoding.code_points("\n".join(texts * 20 + garbled))).astype(int)
    counts += np.bincount(i[:-1] * size + i[1:], minlength=size * size)
    return encoding.Restorer(encoding.pair_scores(counts.reshape(size, size)))


@pytest.mark.parametrize("written,read", GARBLES)
def test_garbled_text_comes_back(restorer, written, read):
    for text in RU:
        bad = "A sound line before.\n" + garble(text, written, read) + "\nand one after"
        found = restorer.restore([bad, text])
        assert list(found) == [0], (written, read, found)
        assert found[0][0] == "A sound line before.\n" + text + "\nand one after"


@pytest.mark.parametrize("first,second", [(("cp1251", "cp1252"), ("koi8_r", "cp1251")), (("koi8_r", "cp1251"), ("cp866", "cp1251"))])
def test_passages_misread_in_two_ways_come_back(restorer, first, second):
    bad = garble(RU[0], *first) + "\nA sound line between.\n" + garble(RU[1], *second)
    found = restorer.restore([bad])
    assert found[0][0] == RU[0] + "\nA sound line between.\n" + RU[1]
    assert all(f"{written} as {read}" in found[0][1] for written, read in (first, second))


def test_sound_texts_stay(restorer, texts):
    rare = ["Řádek patří službě, přečtěte si též", "Ångström, Ørsted and Łódź are rack names", "Допуск ±2 мкм при 25 °C, шаг ½ дюйма, знак § и ¶", "Each optional worker", "├── a\n│   └── b"]
    assert restorer.restore([*texts[:200], *rare, "", "ascii only"]) == {}


def test_lost_characters_are_reported(restorer):
    found = restorer.restore(["the owner can�t change it"])
    assert found[0] == ("the owner can�t change it", None, True)


def test_operator_on_dirty_rows(spark, texts):
    rows = [(k, t) for k, t in enumerate(texts)] * 5 + [(9001, None), (9002, ""), (None, garble(RU[0], "utf-8", "cp1251")), (9003, garble(RU[1], "utf-8", "cp1251"))]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as n", "'x' as restored")
    got = {r.doc_id: r for r in encoding.garbled_documents(df.union(df.where("doc_id = 9003"))).collect()}
    assert list(got) == [9003] and got[9003].restored == RU[1] and not got[9003].damaged
    assert encoding.garbled_documents(df.limit(0)).count() == 0


def test_maximal_segments_match_their_definition():
    def brute(w, a, b):
        best = max(((w[i:j].sum(), -i, -j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0, 0, 0))
        if best[0] <= 0:
            return []
        i, j = -best[1], -best[2]
        return brute(w, a, i) + [(i, j)] + brute(w, j, b)

    rng = np.random.default_rng(0)
    for _ in range(100):
        w = rng.normal(size=rng.integers(1, 20))
        assert encoding.maximal_segments(w) == brute(w, 0, len(w))
