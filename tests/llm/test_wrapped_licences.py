"""Licence texts as files hold them: wrapped at 72 columns, plain or behind comment marks."""

import textwrap

import pytest

from quillstream.llm import licenses

GRANT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
KEEP = "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
FREE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
HOPE = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
BSD = ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."]
ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
MPL = "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."


def file(*paragraphs: str, mark: str = "", end: str = "\n") -> str:
    lines = [x for p in paragraphs for line in [*p.split("\n"), ""] for x in (textwrap.wrap(line, 72) or [""])]
    return end.join(mark + x for x in lines)


@pytest.mark.parametrize("mark,end", [("", "\n"), ("# ", "\n"), (" * ", "\r\n"), ("! ", "\n"), ("//", "\n")])
def test_wrapped_texts_state_their_licence(spark, mark, end):
    f = lambda *p: file(*p, mark=mark, end=end)
    rows = [(1, f("MIT License", "Copyright (c) 2020 Jo Doe", GRANT, KEEP)), (2, f(FREE, HOPE)), (3, f(*BSD)), (4, f("Copyright 2020\n" + ISC)), (5, f(MPL)), (6, f("Released under the MIT License\nand some prose"))]
    got = {r.doc_id: (r.sequence, r.licences) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("mit-grant,mit-keep", "MIT"), 2: ("gpl-free,gpl-hope", "GPL-3.0-or-later"), 3: ("bsd-redistribute,bsd-source,bsd-binary", "BSD-2-Clause"), 4: ("isc-grant", "ISC"), 5: ("mpl-form,mpl-copy", "MPL-2.0"), 6: ("mit-notice", "MIT")}


def test_blank_lines_and_other_words_part_sentences(spark):
    rows = [(1, "Released under\n\nthe MIT License"), (2, "Released under\n#\n# the MIT License"), (3, "Not released under\nthe MIT License"), (4, "Released under.  \n \nthe MIT License"), (5, "Released under\nthe MIT License\nor not"), (6, "Released under\nthe MIT Licenses")]
    got = {r.doc_id: (r.n_sentences, r.n_known) for r in licenses.recognise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: (2, 0), 2: (2, 0), 3: (2, 0), 4: (2, 0), 5: (3, 1), 6: (2, 0)}
