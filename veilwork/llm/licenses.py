"""Licence scan by canonical digests, in DataFrame functions only.

A unit is a whole document, or a whole line of it (a notice).  Units and known texts are put into one canonical form: lower
case, copyright statements left out, line breaks spaces, equivalent spellings made one, everything but letters and digits a single space.  Units whose
digest is that of a known text are found by a hash join on the digest; a text that only contains a licence doesn't match.

Edge cases: null or empty text, or one without letters and digits: no digest, no match; each row is a document, also with a
repeated or null doc_id; an empty table gives an empty result.  Extra columns are not carried.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilwork.llm.common import Store, small

#: Spellings that count as equal (canonical form last).
SPELLINGS = [("licen[cs]e", "license"), ("licen[cs]ed", "licensed"), ("licen[cs]ing", "licensing"),
             ("sub[- ]?licen[cs]e", "sublicense"), ("non[- ]commercial", "noncommercial"), ("per cent", "percent"),
             ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("copyright owner", "copyright holder"),
             ("merchantibility", "merchantability"), ("https", "http")]
#: Words that follow "copyright" in running licence text, where no name stands.
RUNNING_WORDS = (
    r"notices?|holders?|owners?|ownership|licen[cs]es?|licensors?|laws?|statements?|interests?|rights?|protections?|"
    r"infringements?|permissions?|disclaimers?|works?|claims?|status|acts?|treat(?:y|ies)|doctrines?|and|or|nor|in|on|of|to|"
    r"is|are|as|for|under|this|that|which|with|if|where|when|can|may|shall|will|must|has|have|does")
NAMED_BY_ITS_HOLDER = r"\b(?:authors?|contributors?|developers?|regents|project|team)\b"
RUNNING = r"(?:" + RUNNING_WORDS + r"|the(?![^\n]*" + NAMED_BY_ITS_HOLDER + r"))\b"
YEAR = r"(?:(?:19|20)\d\d\b|[<\[{(]\s*(?:years?|yyyy)\b)"
#: A copyright statement: a line that begins with the word or sign and goes on with a sign, a year or a name.
COPYRIGHT = (r"(?m)^[^a-z0-9\n]*(?:(?:copyright[ \t:,]*(?:\(c\)|©|" + YEAR + r")|copyright[ \t]+(?:by[ \t]+)?(?!" + RUNNING
             + r")[<\[{]?\p{L}|\(c\)[ \t:,]*(?:copyright\b|" + YEAR + r")|©)[^\n]*$|all rights reserved\b)")

#: Known texts; `known_texts` adds the whole texts in `license_texts`, notices, titles and SPDX lines.
KNOWN = [
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES
OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE
LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """ISC License

Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED
WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR
CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT,
NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
]

#: Titles under which a text also stands; the text without a title is known too.
TITLES = {
    "MIT": ["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)"],
    "ISC": ["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)"],
    "0BSD": ["BSD Zero Clause License", "Zero-Clause BSD", "BSD-0-Clause", "0BSD"],
    "BSD-2-Clause": ["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", "Simplified BSD License", "FreeBSD License",
                     'BSD 2-Clause "Simplified" License', "BSD License", "The BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "Modified BSD License",
                     'BSD 3-Clause "New" or "Revised" License', "BSD License", "The BSD License"],
    "Zlib": ["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"],
    "BSL-1.0": ["Boost Software License 1.0"],
    "Unlicense": ["The Unlicense", "Unlicense"],
}

#: Names of licences in one-line notices.
NAMES = {
    "MIT": ["MIT License", "MIT"], "ISC": ["ISC License"], "BSL-1.0": ["Boost Software License, Version 1.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"], "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License", "Apache License, Version 2.0 (the \"License\")"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "Unlicense": ["Unlicense"], "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0"],
    **{f"{i}-{v}": [n.format(s) for s in {v, v.removesuffix(".0")} for n in (f"{name}, version {{}}", f"{name} version {{}}", f"{name} v{{}}",
                                                                             f"{i} v{{}}", f"{i}v{{}}", f"{i}-{{}}")]
       for i, name, vs in (("GPL", "GNU General Public License", ("1.0", "2.0", "3.0")), ("AGPL", "GNU Affero General Public License", ("3.0",)),
                           ("LGPL", "GNU Lesser General Public License", ("2.1", "3.0")), ("LGPL", "GNU Library General Public License", ("2.0",)))
       for v in vs},
    **{f"CC-{k.upper()}-{v}": [f"CC {k} {v}", f"CC-{k} {v}", f"Creative Commons {long} {v} International License" if v == "4.0" else
                               f"Creative Commons {long} {v} Unported License", f"Creative Commons {long} {v} License"]
       for k, long in (("by", "Attribution"), ("by-sa", "Attribution-ShareAlike"), ("by-nc", "Attribution-NonCommercial"),
                       ("by-nd", "Attribution-NoDerivatives"), ("by-nc-sa", "Attribution-NonCommercial-ShareAlike"),
                       ("by-nc-nd", "Attribution-NonCommercial-NoDerivatives")) for v in ("3.0", "4.0")},
}
FRAMES = ["Licensed under {}.", "Licensed under the {}.", "Released under {}.", "Released under the {}.", "Distributed under the {}.",
          "This work is licensed under {}.", "This work is licensed under the {}.", "This work is licensed under a {}.",
          "This project is licensed under the {}.", "This software is licensed under the {}.", "This file is licensed under the {}.",
          "This software is released under the {}.", "License: {}."]

#: Standard notices of the long licences.
APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use {} except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in
writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,
either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GNU = """This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free
Software Foundation, either version {v} of the License, or (at your option) any later version. This {what} is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the {name} for more details. You should have received a copy of the {name} along with this {what}{end}"""
ENDS = [". If not, see <https://www.gnu.org/licenses/>.", "; if not, see <https://www.gnu.org/licenses/>.", ". If not, see <https://gnu.org/licenses/>.",
        "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
        "; if not, write to the Free Software Foundation, Inc., 59 Temple Place, Suite 330, Boston, MA 02111-1307 USA."]
NOTICES = [
    *[("Apache-2.0", APACHE.format(what)) for what in ("this file", "this work", "this software")],
    *[(f"{i}-{v}-or-later", GNU.format(what=what, name=name, v=n, end=end))
      for i, name, pairs in (("GPL", "GNU General Public License", (("2.0", "2"), ("3.0", "3"))),
                             ("AGPL", "GNU Affero General Public License", (("3.0", "3"),)),
                             ("LGPL", "GNU Lesser General Public License", (("2.1", "2.1"), ("3.0", "3"))))
      for v, n in pairs for what in ("program", "library", "file", "software") for end in ENDS],
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("BSL-1.0", """Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at
https://www.boost.org/LICENSE_1_0.txt)"""),
]
SPDX = [*TITLES, "Apache-2.0", "MIT-0", "MPL-1.1", "MPL-2.0", "EPL-1.0", "EPL-2.0", "CDDL-1.0", "CC0-1.0", "Artistic-1.0", "Artistic-2.0", "WTFPL",
        "PostgreSQL", "NCSA", "Python-2.0", "BSD-4-Clause", "EUPL-1.2", "OFL-1.1", "Apache-2.0 WITH LLVM-exception",
        "GPL-2.0-only WITH Linux-syscall-note", "GPL-2.0 WITH Linux-syscall-note", "Apache-2.0 OR MIT", "MIT OR Apache-2.0",
        *[f"{i}{end}" for i in NAMES if "GPL" in i for end in ("", "-only", "-or-later")], *[i for i in NAMES if i.startswith("CC-")],
        *[f"GFDL-{v}{end}" for v in ("1.1", "1.2", "1.3") for end in ("", "-only", "-or-later")]]


def known_texts(folder: str | Path = Path(__file__).parent / "license_texts") -> list[tuple[str, str]]:
    """KNOWN, the texts of a folder (named by licence), these under their titles and without, notices and SPDX lines."""
    whole = [(f.stem, f.read_text()) for f in sorted(Path(folder).glob("*.txt"))]
    whole += [(k, t.split("\n", 1)[1]) for k, t in KNOWN if "\n\n" in t]
    whole += [(k, t.replace("and/or distribute", "and distribute")) for k, t in whole if k == "ISC"]
    whole += [(k, t.split("\n", 1)[1]) for k, t in whole if k == "BSL-1.0"]
    # clauses with and without numbers; long texts with and without the appendix that tells how to apply them
    whole += [(k, re.sub(r"(?m)^\s*\d\. ", "", t)) for k, t in whole if k in ("BSD-2-Clause", "BSD-3-Clause", "Zlib")]
    whole += [(k, t[:m.end()] if end else t[:m.start()]) for k, t in whole if (m := re.search("END OF TERMS AND CONDITIONS", t)) for end in (0, 1)]
    titled = [(k, f"{title}\n\n{t}") for k, t in whole for title in TITLES.get(k, [])]
    lines = [(k, frame.format(name)) for k, names in NAMES.items() for name in names for frame in FRAMES]
    tags = [(k, f"SPDX-License-Identifier: {k}") for k in SPDX]
    return [*KNOWN, *whole, *titled, *lines, *NOTICES, *tags]


def canonical(text: Column) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(text), COPYRIGHT, " "), r"\s+", " ")
    out = F.replace(out, F.lit("- "), F.lit("-"))  # also words that are broken at their hyphen
    for spelling, one in SPELLINGS:
        out = F.regexp_replace(out, spelling, one)
    return F.trim(F.regexp_replace(out, r"[^\p{L}\p{N}]+", " "))


def known_digests(spark, known: Sequence[tuple[str, str]], files: Sequence[str] = ()) -> DataFrame:
    """Digests of known texts, and of more text files (paths or patterns for Spark) that are named by their licence."""
    texts = spark.createDataFrame(list(known), "license string, text string")
    if files:
        name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[^.]*$", "")
        texts = texts.union(spark.read.text(list(files), wholetext=True).select(F.url_decode(name), "value"))
    return (texts.select("license", canonical(F.col("text")).alias("c")).where("c <> ''")
            .groupBy(F.md5("c").alias("digest")).agg(F.min("license").alias("license")))


def license_scan(docs: DataFrame, known: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, digest, license (of the whole text), n_notices, notices (licences of whole lines, sorted, by comma).

    `known` has columns digest and license, one row per digest.
    """
    store = Store(docs.sparkSession)
    body = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    lines = F.when(F.instr(body, "\n") > 0, F.split(body, "\n", -1)).otherwise(F.array(body))
    digest = lambda c: F.when(c != "", F.md5(c))
    base = store.keep(docs.select(F.col(f"`{key}`").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                                  canonical(body).alias("c"), F.transform(lines, canonical).alias("ls"))
                      .select("doc_id", "row", digest(F.col("c")).alias("digest"), F.transform("ls", digest).alias("lines")),
                      "digests")
    known = small(store.keep(known, "known"))
    hits = base.select("row", F.explode("lines").alias("digest")).join(known, "digest")
    notices = hits.groupBy("row").agg(F.count(F.lit(1)).alias("n_notices"),
                                      F.array_join(F.array_sort(F.collect_set("license")), ",").alias("notices"))
    return base.join(known, "digest", "left").join(notices, "row", "left").select(
        "doc_id", "digest", "license", F.coalesce("n_notices", F.lit(0)).cast("long").alias("n_notices"), "notices")
