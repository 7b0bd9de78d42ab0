"""Threats are read by the grammar without any lexeme, and with their target before or behind them."""

import pytest

from pointgrain.llm import toxicity


def threat(text):
    return toxicity.text_features(text, {}, frozenset())[:5]


@pytest.mark.parametrize("text", ["I will kill you", "they kill", "you will burn", "so. we shoot them!"])
def test_threats_without_lexemes_fire_once(text):
    assert threat(text) == pytest.approx([0, 0, 0, 0, 0.6931471805599453])


def test_threats_without_a_target_or_in_another_clause_do_not_fire():
    assert threat("kill the process. you see") == threat("burn the wood") == threat(None) == [0] * 5


def test_negated_and_reported_threats():
    assert [x > 0 for x in threat("I will not kill you")] == [False, False, True, False, False]
    assert [x > 0 for x in threat("it said kill you")] == [False, False, False, True, False]
