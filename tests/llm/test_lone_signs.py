"""Addresses whose only signs are a lone at or dot are looked at too."""

from __future__ import annotations

import pytest

from trailmark.llm import pii


@pytest.mark.parametrize("said", ["anna at mail.de", "jo at host . de", "jo ( at ) host.org", "jo [ at ] host [ dot ] org", "jo AT news . host . de", "jo[at ]host.de"])
def test_a_spoken_address_is_in_one_window(said):
    text = f"one two three four five {said} six seven eight nine ten"
    a = text.index(said)
    assert any(w[0][0] <= a and w[-1][1] >= a + len(said) for w in pii.windows(text))


def test_an_address_with_a_lone_at_is_found():
    text = "please write anna at mail.de today"
    spots = pii.windows(text)
    paths = pii.viterbi(pii.train(pii.labelled_table()), [[text[a:b] for a, b in s] for s in spots])
    assert ("email", 13, 28) in pii.added_spans(text, spots, paths, pii.base_spans(text))
