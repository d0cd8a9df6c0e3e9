"""Surroundings of seeds that the bounded-error matching need not look at."""

import random

from volpanel.llm.licences import BASE, CHARACTERS_PER_EDIT, NOTICES, Scanner, telling, whole_words


class Counted:
    def __init__(self, pattern):
        self.pattern, self.calls = pattern, 0

    def search(self, *window):
        self.calls += 1
        return self.pattern.search(*window)


def counted(scanner):
    for notice in scanner.notices:
        notice.pattern = Counted(notice.pattern)
    return lambda: sum(notice.pattern.calls for notice in scanner.notices)


def test_only_surroundings_with_enough_of_a_notice_are_matched():
    scanner = Scanner(BASE, NOTICES, CHARACTERS_PER_EDIT)
    calls = counted(scanner)
    text = " you may not leave the house today in compliance with the rules of the general public and subject to the weather \n"
    assert len(list(scanner.automaton.iter(text))) > 0  # there are seeds
    assert list(scanner.fuzzy(text)) == [] and calls() == 0
    version = " licensed under the gnu general public license version 4 \n"
    assert list(scanner.fuzzy(version)) == [] and calls() == 0
    found = [m[2] for m in scanner.fuzzy(" licensd under the gnu general public license version 3 \n")]
    assert found == ["gpl-3"] and calls() == 1


def test_no_match_that_counts_is_left_out():
    rng = random.Random(8)
    scanner = Scanner(BASE, NOTICES, CHARACTERS_PER_EDIT)
    matched = 0
    for _ in range(1500):
        notice = rng.choice(scanner.notices)
        letters = list(notice.words)
        for _ in range(rng.randint(0, notice.edits + 1)):
            at = rng.randrange(len(letters))
            letters[at : at + rng.randint(0, 1)] = rng.choice(["", " ", "x", "e"])
        text = f" some words {' '.join(''.join(letters).split())} and more \n"
        found = notice.pattern.search(text)
        if found and telling(whole_words(text, *found.span())) == telling(notice.words):
            matched += 1
            assert notice.possible(text, *found.span()) and notice.possible(text, 0, len(text))
    assert matched > 500
