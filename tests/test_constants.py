import math

from corpus_curator import constants as C


def test_fixed_values_are_consistent():
    assert len(C.FIRST_LEVEL_TAGS) == 21 and len(set(C.FIRST_LEVEL_TAGS)) == 21
    assert sorted(C.RATING_TASKS) == sorted(C.SCORE_FIELDS)
    assert set(C.RATING_WEIGHTS) == set(C.SCORE_FIELDS)
    assert math.isclose(sum(C.RATING_WEIGHTS.values()), 1.0)
    assert C.SMALL_PROMPT_TOKENS < C.MAX_PROMPT_TOKENS
