"""Citations of licences as they are written, and texts of licences without their names."""

import pytest

from clickmart.llm.license_rules import rules
from clickmart.llm.license_scan import scanner, words_of

CITED = [
    ("Creative Commons Attribution 4.0 International", "cc-by-4.0"),
    ("licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa-4.0"),
    ("Creative Commons Attribution-NonCommercial-NoDerivatives 4.0", "cc-by-nc-nd-4.0"),
    ("Attribution-NonCommercial-ShareAlike 3.0 Unported", "cc-by-nc-sa-3.0"),
    ("released under GPLv3", "gpl-3.0"),
    ("GPLv2 or later", "gpl-2.0-or-later"),
    ("LGPLv2.1", "lgpl-2.1"),
    ("uses the AGPLv3.", "agpl-3.0"),
    ('license = "Apache-2.0"', "apache-2.0"),
    ("Apache-2.0", "apache-2.0"),
    ('license = { text = "MIT" }', "mit"),
    ("licensed under the GPL", "gpl"),
    ("see the Apache License for more", "apache"),
    ("the Mozilla Public License", "mpl"),
    ("the GNU Lesser General Public License", "lgpl"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software", "mit"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", "bsd-3-clause"),
    ("under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version", "gpl-3.0-or-later"),
    ("Apache License, v. 2.0", "apache-2.0"),
    ("GPL-2.0-or-later", "gpl-2.0-or-later"),
    ("SPDX-License-Identifier: GPL-3.0-or-later", "gpl-3.0-or-later"),
    ("Licensed under Apache 2.0", "apache-2.0"),
    ("Licensed under Apache 2", "apache-2.0"),
    ("released under the Apache v2.0", "apache-2.0"),
    ("GNU General Public License v2.0 or later", "gpl-2.0-or-later"),
    ("licensed under GPL 3 or later", "gpl-3.0-or-later"),
    ("licensed under the MPL 2.0", "mpl-2.0"),
    ("licensed under LGPL 2.1", "lgpl-2.1"),
    ("CC-BY 4", "cc-by-4.0"),
    ("CC BY-NC-SA 4.0", "cc-by-nc-sa-4.0"),
    ("licensed under CC BY-SA 3.0", "cc-by-sa-3.0"),
    ("licensed under the BSD 3-clause license", "bsd-3-clause"),
]


def labels(text):
    return {rule.label for _, _, rule in scanner().detections(words_of(text.encode()))}


@pytest.mark.parametrize("text, label", CITED)
def test_citations_have_their_label_only(text, label):
    assert labels(text) == {label}


@pytest.mark.parametrize("text", ["a curl of json", "python 2.0 came out", "stand by 4 0 men", "the ruby is red", "we share a license"])
def test_plain_words_have_none(text):
    assert labels(text) == set()


def test_two_licences_of_one_family_stay_both():
    assert labels("Dual: GPL-2.0 here, GPL-3.0-or-later there; Apache 2.0, and Apache-1.1") == {
        "gpl-2.0", "gpl-3.0-or-later", "apache-2.0", "apache-1.1"
    }


def test_families_of_another_name_are_not_suppressed_by_the_wider_one():
    assert labels("the MIT License") == {"mit"}
    assert labels("licensed under the terms of the MIT License or GPLv3") == {"mit", "gpl-3.0"}


def test_a_match_has_a_gate():
    for text, _ in CITED:
        words = words_of(text.encode())
        joined = " " + b" ".join(words).decode() + " "
        assert all(rule.gates & {w.decode() for w in words} for rule in rules() if rule.pattern.search(joined))
