"""Line shapes that end their line although the vote takes the text as wrapped."""

import pytest

from tickloom.llm.sentences import sentences

CASES = [
    "\n Profit factor:\t$4,458.58|Avg. trade ........ $1,818|Mr. Zanwi and Ms. Malunzan share one machine, e.g. for sweeps.",
    "Avg. trade ........ 81|Net result:\t3,103.55|The mean is 857.1.",
    "Net result:\t204|Avg. trade:\t33|It was late.",
    "## Before you start|Mr. Shohepde shares one machine.",
    "We ran it twice on\none tape.\n\n- Let it run.\n\nIt was fine|Zanwi: was it?",
    "It held until\nnoon.\n\n- Let it run.\n\nThanks for all|-- Zanwi",
]


@pytest.mark.parametrize("case", CASES)
def test_shapes_end_their_line(case):
    text = case.replace("|", "\n")
    got = [text[a:b] for a, b in sentences(text)]
    for line in (x for part in case.split("|") for x in [part.split("\n\n")[-1].strip()]):
        assert line in got


def test_wrapped_arithmetic_stays_whole():
    text = "It ran.\n\n- Let it run.\n\nThe target is the fill\n+ 5,850.3 and no more."
    assert [text[a:b] for a, b in sentences(text)][-1] == "The target is the fill\n+ 5,850.3 and no more."
