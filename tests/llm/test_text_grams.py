"""n-grams of texts against a walk over their units."""
import numpy as np
import pyarrow as pa

from kestrel.llm import perplexity as PX
from kestrel.llm.common import split_words


def test_text_grams_and_their_places():
    texts = ["a", None, "", "ab cd ab cd", "é 日本 x", "abcdefghij", " q "]
    words, off = split_words(pa.array(texts, pa.string()))
    grams, ends = PX.text_grams(words, off)
    want, at = [], [0]
    for t in texts:
        if (t or "").split():
            units = [PX._START]
            for i, word in enumerate(t.split()):
                units += [PX._SPACE] * (i > 0) + PX._units(pa.array([word]))[0].tolist()
            units.append(PX._END)
            for i in range(1, len(units)):
                want.append(sum(u << PX.CHAR_BITS * j for j, u in enumerate(units[i::-1][:PX.ORDER])))
        at.append(len(want))
    assert grams.tolist() == want and ends.tolist() == at
    distinct, place = PX._distinct(grams)
    assert distinct.tolist() == sorted(set(want)) and (distinct[place] == grams).all()
    assert [len(x) for x in PX._distinct(np.zeros(0, np.int64))] == [0, 0]
