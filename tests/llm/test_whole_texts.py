"""Features and removals that must not change with the size or the number of the rows."""

from __future__ import annotations

import random

import pytest

from kvloom.llm import repeats, toxicity
from test_copies import brute_repeats


def test_disguised_words_of_long_texts_count():
    """Seen before or not, few or many: each disguised hit counts."""
    f = toxicity.Featurizer([("idiot", 2.0), ("moron", 1.5)])
    hidden = toxicity.NAMES.index("hidden")
    for times in (1, 300, 1000, 4000):
        x = f("1diot, MORON you m0r0n! (idiot) b4d " * times)
        assert x[hidden] == 2 * times
        assert x[toxicity.NAMES.index("hits")] == 4 * times and x[toxicity.NAMES.index("near")] == 4 * times
    assert f("idiot moron.")[hidden] == 0


@pytest.mark.parametrize("n_parts", [1, 5])
def test_rows_that_repeat_an_id_are_one_document(spark, n_parts):
    """Each gives its document's result; what occurs under no other id stays, unless it repeats inside the document."""
    rnd = random.Random(6)
    word = lambda n: "".join(rnd.choices("abcdefgh ", k=n))
    passage = word(140)
    texts = {1: word(400), 2: word(90) + passage + word(50), 3: word(200) + passage, 4: passage + word(30) + passage, 5: "x" * 700, 6: "short", 7: word(3000)}
    texts |= {8: texts[7][500:1500] + word(200), 9: texts[1]}
    rows = [(i, t) for i, t in texts.items() for _ in range(1 + i % 4)]
    rnd.shuffle(rows)
    want = brute_repeats(list(texts.items()))
    got = [(r[0], (r[1], r[2], r[3], bytes(r[4]))) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(n_parts)).collect()]
    assert sorted(i for i, _ in got) == sorted(i for i, _ in rows)
    assert all(v == want[i] for i, v in got) and want[1][1] == 0 and want[5][1] > 0
