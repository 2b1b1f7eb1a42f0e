"""Licence notices as they stand in files: wrapped, commented, between prose."""

from __future__ import annotations

import textwrap

import pytest

from tessella.llm.license_scan import default_model

NOTICES = {
    "mit": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}


@pytest.mark.parametrize("columns", [20, 40, 70, 80])
@pytest.mark.parametrize("mark", ["", "# ", " * "])
def test_wrapped_notices(columns, mark):
    model = default_model()
    for family, notice in NOTICES.items():
        lines = [mark + x for x in textwrap.wrap(notice, columns)]
        before = ["The river rose in the spring of that year and the old bridge was lost.", mark.rstrip(), mark + "Copyright (c) 2019 Ann Other", mark.rstrip()]
        found = model.scan(["\n".join([*before, *lines, mark.rstrip(), "import os"])])[0]
        assert [(4, family)] == [(n, f) for n, f, _ in found], (family, found)


@pytest.mark.parametrize("columns", [40, 70, 80])
def test_wrapped_notices_within_prose(columns):
    model = default_model()
    prose = "They walked along the quiet lane and spoke of the harvest, the weather and the price of corn in the town."
    for family, notice in NOTICES.items():
        found = model.scan([textwrap.fill(f"{prose} {notice} {prose}", columns)])[0]
        assert [f for _, f, _ in found] == [family], (family, found)


def test_blank_lines_part_paragraphs():
    words = NOTICES["bsd"].split()
    text = " ".join(words[:10]) + "\n\n" + " ".join(words[10:])
    assert default_model().scan([text, "", None, "\n\n", text.replace("\n\n", "\n")])[:4] == [[], [], [], []]
    assert [(n, f) for n, f, _ in default_model().scan([text.replace("\n\n", "\n")])[0]] == [(0, "bsd")]
