"""The document statistics against definitions written out one by one."""

import math
import statistics as plain

import numpy as np
import pytest

from stridelake.llm import quality

TEXTS = [
    "", " ", "\n\n", "One two. Three four!\nA short line\n\nA short line\nTHIS IS LOUD, 12 times; a b c d", "é ü “quoted” (word) *starred* $5 … end…",
    "same same same same " * 40, "x\x00y\tz\x7f", "word " * 50_000 + ".\n" + "A line that ends here.\n" * 30,
]


def written_out(text):
    data, words, lines = text.encode(), text.split(), text.split("\n")
    n, n_words, n_lines = max(1, len(data)), max(1, len(words)), len(lines)
    odds = lambda hits, of: math.log((hits + 0.5) / (of - hits + 0.5))
    share = lambda part, of, scale: odds(scale * part / of, scale)
    kind = {k: 0 for k in ("marks", "lower", "upper", "digits", "spaces", "stops", "beyond", "control")}
    for b in data:
        c = chr(b)
        name = (
            "beyond" if b > 127 else "lower" if "a" <= c <= "z" else "upper" if "A" <= c <= "Z" else "digits" if "0" <= c <= "9" else "spaces" if c in " \t\n\x0b\x0c\r"
            else "stops" if c in ".," else "control" if b < 32 or b == 127 else "marks"
        )
        kind[name] += 1
    low = [w.lower() for w in words]
    full = [x.strip() for x in lines if x.strip()]
    n_full = max(1, len(full))
    lengths = [len(w) for w in words] or [0]
    pairs = len(words) - 1
    odd = [w for w in words if (not w[-1].isalnum() and w[-1] not in ".,;:!?") or (not w[0].isalnum() and w[0] not in "\"'(")]
    return {
        "log_chars": math.log1p(len(data)), "log_words": math.log1p(len(words)), "log_lines": math.log1p(n_lines),
        "word_length": math.log(plain.fmean(lengths) + 0.5), "word_length_spread": math.log1p(plain.pstdev(lengths)),
        **{k: odds(v, n) for k, v in kind.items()},
        "distinct_words": odds(len(set(low)), n_words), "commonest_word": odds(max((low.count(w) for w in set(low)), default=0), n_words),
        "shouted_words": odds(sum(len(w) > 1 and w.isupper() for w in words), n_words), "capital_words": odds(sum(w[0].isupper() for w in words), n_words),
        "marked_words": odds(len(odd), n_words), "bare_words": odds(sum(w.isalpha() for w in words), n_words), "single_letters": odds(sum(len(w) == 1 for w in words), n_words),
        "repeated_pairs": share(pairs - len(set(zip(low, low[1:]))), pairs, n_words) if pairs > 0 else odds(0, n_words),
        "repeated_lines": odds((1 - len(set(full)) / n_full) * n_lines, n_lines),
        "ended_lines": odds(sum(x.endswith((".", "!", "?", ":", '"', "'", ")", "…")) for x in full) / n_full * n_lines, n_lines),
        "short_lines": odds(sum(len(x) < 30 for x in full) / n_full * n_lines, n_lines),
        "words_a_line": math.log1p(len(words) / n_full), "log_stop_gap": math.log1p(len(words) / (1 + text.count("."))),
    }


@pytest.mark.parametrize("text", TEXTS)
def test_statistics(text):
    want = written_out(text)
    assert set(want) == set(quality.NAMES) and np.allclose(quality.statistics(text), [want[k] for k in quality.NAMES], rtol=1e-9, atol=1e-9)
