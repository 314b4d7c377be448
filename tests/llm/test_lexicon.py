"""Words stay terms beside the stems that cover them."""

from dwelltrace.llm import toxicity

# (text, is a stem, toxic documents, clean documents) as learned from inflections and typos.
MINED = [
    ("idiot", False, 90, 0),
    ("idiots", False, 30, 0),
    ("idiotic", False, 20, 0),
    ("idixt", False, 9, 0),
    ("idio", True, 130, 0),
    ("idiot", True, 50, 0),
    ("wretchling", False, 60, 0),
    ("wret", True, 75, 0),
    ("house", False, 20, 400),
]


def test_misspelled_first_letters_hit_beside_stems():
    terms = toxicity.choose_terms(MINED, 300, 1000, 400)
    match = toxicity.LexiconAutomaton(terms).match
    for word in ("idiot", "xdiot", "ibiot", "diot", "idot", "idiotically", "wretchling", "vretchling", "wxetchlinx", "idxots"):
        assert match(word), word
    assert not match("house") and not match("wrxy")


def test_covered_stems_and_rare_misspellings_are_no_terms():
    terms = [(t.text, t.stem) for t in toxicity.choose_terms(MINED, 300, 1000, 400)]
    assert ("idio", True) in terms and ("idiot", True) not in terms
    assert ("idixt", False) not in terms
    assert {w for w, stem in terms if not stem} == {"idiot", "idiots", "idiotic", "wretchling"}


def test_covered_words_take_no_place_from_others():
    terms = [(t.text, t.stem) for t in toxicity.choose_terms(MINED, 300, 1000, 2)]
    assert {("idio", True), ("wret", True), ("idiot", False), ("wretchling", False)} <= set(terms)


def test_one_edit():
    assert all(toxicity._one_edit("idiot", w) for w in ("idixt", "diot", "idiots", "xidiot", "idioot"))
    assert not any(toxicity._one_edit("idiot", w) for w in ("idiot", "idito", "dixt", "idiotic"))
