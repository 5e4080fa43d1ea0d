"""Disguised words are read back, whatever their length or share of letters."""

import itertools

import numpy as np
import pytest

from dewfall.llm import toxicity

TEXT = "you are such a stupid idiot and a dumbass said the man. an ass is an animal. that is some shit to say. hello all of you, we will see the moon. "


def restorer():
    counts = np.zeros(toxicity.SIZE**3)
    x = toxicity._BYTES[np.frombuffer((" " + TEXT * 20).encode("latin-1"), np.uint8)]
    np.add.at(counts, x[:-2] * toxicity.SIZE**2 + x[1:-1] * toxicity.SIZE + x[2:], 1)
    return toxicity.Restorer(toxicity.trigram_costs(counts))


DISGUISED = [("st" + "u" * 60 + "pid", "stupid"), ("i" * 45 + "diot", "idiot"), ("5h17", "shit"), ("a55", "ass"), ("dumba55", "dumbass"), ("a$$", "ass"), ("a$$,", "ass"), ("stuupid", "stupid"), ("1d10t!", "idiot")]


def words(text, lexicon=()):
    return toxicity.Featurizer(restorer().costs, frozenset(lexicon)).words(["so", text])[1]


@pytest.mark.parametrize(("token", "word"), DISGUISED)
def test_disguised_token(token, word):
    assert word in words(token)


def test_plain_tokens_and_ids_stay():
    for token in ("man.", "hello,", "moon", "4f3a9c0d7e21b5568f", "ann@example.org", "2024"):
        assert words(token) == {token.rstrip(".,")}


SPELLED = ["a s s", "i  d  i  o  t", "i . d . i . o . t", "s\th\ti\tt", "i\nd\ni\no\nt", "i/d/i/o/t", "s t u p 1 d"]


@pytest.mark.parametrize("text", SPELLED)
def test_spelled_words(text):
    want = {"a": "ass", "i": "idiot", "s": "shit"}[text[0]] if "1" not in text else "stupid"
    assert want in words(f"so {text} there")


def test_spelled_sentence_keeps_word_boundaries():
    assert {"stupid", "idiot"} <= words("y o u  s t u p i d  i d i o t")


@pytest.mark.parametrize(("text", "word"), [("id iot", "idiot"), ("st upid", "stupid"), ("a n i d i o t", "idiot"), ("s tu-pi\nd", "stupid"), ("stupi/d", "stupid")])
def test_cut_words(text, word):
    lexicon = ["idiot", "stupid"]
    assert word in words(f"so {text} there", lexicon)
    assert words("an idiot, a stupid man", lexicon) == {"an", "idiot", "a", "stupid", "man"}


def test_words_do_not_join_across_texts():
    features = toxicity.Featurizer(restorer().costs, frozenset(["idiot"]))
    assert features.words(["so id", "iot", "i d", "i o t", None, ""]) == [{"so", "id"}, {"iot"}, {"i", "d"}, features.words(["i o t"])[0], set(), set()]


def test_features_are_those_of_the_words():
    """Array forms against one word at a time."""
    features = toxicity.Featurizer(restorer().costs)
    texts = ["the man said a moon", "st", "x", "", None, "stuuupid a$$ hello", "ünïcode 中文 \U0001f600 end"]
    doc, feature, n = features(texts)
    for k, (text, own) in enumerate(zip(texts, features.words(texts), strict=True)):
        want = set()
        for w in own:
            want.add(toxicity.word_feature(w))
            padded = np.array([toxicity._FIRST, *map(ord, w), toxicity._LAST], "<u4")
            for at in range(len(w) - 1):
                gram = padded[at : at + 4].astype(np.uint64)
                low = toxicity.VALUES[(gram & np.uint64(0xFFFF)).astype(int)] + (gram >> np.uint64(16))
                with np.errstate(over="ignore"):
                    want.add(int(toxicity.mixed((low * toxicity._GRAM[: len(low)]).sum(keepdims=True, dtype=np.uint64))[0] % toxicity.FEATURES))
        assert set(feature[doc == k].tolist()) == want


def by_hand(costs, token):
    """The cheapest reading by trying every path through the lattice."""
    best = None
    for path in itertools.product(*toxicity.Restorer(costs).lattice(token)):
        cost, a, b = sum(c for _, c in path), 0, 0
        for ch in "".join(x for x, _ in path):
            k = toxicity._INDEX.get(ch, 0)
            cost, a, b = cost + costs[a, b, k], b, k
        cost += costs[a, b, 0]
        if best is None or cost < best[0]:
            best = (cost, "".join(x for x, _ in path))
    return best


@pytest.mark.parametrize("token", ["1d10t", "st00pid", "a$$", "h3ll0!", "s-h-1-t", "xx11xx", "i.d.i", "£0££"])
def test_decoding_is_the_best_of_all_paths(token):
    costs = restorer().costs
    cost, reading = by_hand(costs, token)
    got = toxicity.Restorer(costs).decode(token)
    assert got == reading or by_cost(costs, token, got) == pytest.approx(cost)


def by_cost(costs, token, reading):
    return min(
        sum(c for _, c in path) + total(costs, reading)
        for path in itertools.product(*toxicity.Restorer(costs).lattice(token))
        if "".join(x for x, _ in path) == reading
    )


def total(costs, reading):
    cost, a, b = 0.0, 0, 0
    for ch in reading:
        k = toxicity._INDEX.get(ch, 0)
        cost, a, b = cost + costs[a, b, k], b, k
    return cost + costs[a, b, 0]


def test_disguised_rows_are_caught(spark):
    """Planted rows: the word stands plainly in labelled rows only; held-out rows carry it disguised."""
    words = TEXT.replace(".", "").replace(",", "").replace("idiot", "man").split()
    text = lambda k, word: " ".join([*(words[(k * 7 + j * j) % len(words)] for j in range(12)), word, words[k % len(words)]])
    disguises = ["idiot", "id iot", "i d i o t", "i . d . i . o . t", "1d10t", "i" * 50 + "diot"]
    docs = [(k, text(k, "idiot" if k % 3 == 0 else "man")) for k in range(600)] + [(1000 + k, text(k, d)) for k, d in enumerate(disguises)] + [(2000 + k, text(k, "man")) for k in range(20)]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(600)], "doc_id long, toxic int")
    got = {r.doc_id: r.predicted for r in toxicity.score(table, labels).collect()}
    assert [got[1000 + k] for k in range(len(disguises))] == [1] * len(disguises)
    assert not any(got[2000 + k] for k in range(20))


def test_letters_alone_as_the_decoder_reads_them():
    restore = restorer()
    for word in ("hello", "stuupid", "stuuupid", "aass", "moon", "llaannddd", "ssaid", "will", "wwiilll"):
        assert restore.shortened(word) == restore.decode(word)


def test_repeated_ids_train_one_model(spark):
    rows = [(i, f"you stupid idiot number {i}" if i % 2 else f"the moon over hill {i} was bright") for i in range(60)]
    again = [(i, f"{t} {k} times") for i, t in rows for k in range(12)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(3, 0), (3, 1)], "doc_id long, toxic int")
    costs = toxicity.trigram_costs(np.ones(toxicity.SIZE**3))
    for few in (100, 5):
        models = [
            toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels, costs, few, few) for r, n in ((again, 2), (again[::-1], 5))
        ]
        assert (models[0].odds == models[1].odds).all() and (models[0].weights == models[1].weights).all() and models[0].lexicon == models[1].lexicon
