"""The reading cost is one measure for every length."""

import pytest

from pinwall.functions import similarity as S


def test_reading_cost_has_no_switch_by_length():
    for a, b in (("0", "o"), ("rn", "m"), ("m", "rn"), ("ab", "ba"), ("a", ""), ("x", "q")):
        short = S.reading_cost("z" + a + "z", "z" + b + "z")
        for n in (50, 198, 202, 600):
            assert S.reading_cost("z" * n + a + "z" * n, "z" * n + b + "z" * n) == pytest.approx(short)
    assert S.reading_cost("z" * 300 + "rn", "z" * 300 + "m") < S.osa("z" * 300 + "rn", "z" * 300 + "m")
