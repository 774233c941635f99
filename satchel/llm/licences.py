"""Licence scan by canonical digests.

A text is reduced to a canonical form: lower case, copyright lines dropped,
equivalent spellings made one, everything but letters and digits made single
spaces. A copyright line carries a year, a sign or a holder; lines of a wrapped
text that begin with the word ("copyright notice ...") or with an item "(c)
you must ..." stay. Titles are part of the form, so texts are known with each. Texts of one canonical form have one digest, and the digests of whole
texts are joined with those of known licences. Both whole documents and their
single lines (for one-line notices) are looked up.

Defined results: a null text has no digest and no licence; a text whose
canonical form is empty matches nothing; known texts of equal form are known
by the smallest name; rows that repeat an id share the notices found for it;
other columns are kept by ``with_digest`` and ignored by ``scan``.
"""

from __future__ import annotations

import re
from importlib.resources import files

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from satchel.session import broadcast_if_small

# Spellings held equal; single words where they can be, as a wrapped line may end between two.
SPELLINGS = [
    ("licence", "license"), ("sub-license", "sublicense"), ("sub license", "sublicense"), ("non-commercial", "noncommercial"),
    ("owner", "holder"), ("holders", "holder"), ("favour", "favor"),
    ("organisation", "organization"), ("acknowledgement", "acknowledgment"), ("fulfil ", "fulfill "), ("fulfil\n", "fulfill\n"), ("sub\nlicense", "sublicense"), ("per\ncent", "percent"), ("behaviour", "behavior"),
    ("per cent", "percent"), ("https:", "http:"),
]
def _unlike(words: list[str], never: str = "") -> str:
    """A pattern, without look-ahead, of what departs from all ``words``; its
    first character is none of ``never``."""
    tails: dict[str, list[str]] = {}
    for w in words:
        tails.setdefault(w[0], []).append(w[1:])
    deeper = [c + _unlike(rest) for c, rest in sorted(tails.items()) if "" not in rest]
    return "(?:" + "|".join([f"[^{''.join(sorted(tails))}{never}\\n]", *deeper]) + ")"


# How lines of licence texts go on after "copyright" and after an item's "(c)".
NO_HOLDERS = (
    "and ,and/,are ,certain ,claim,conditions,disclaim,doctrin,for ,holder,if ,in ,including,information,infring,interest,is ,law,licen,message,notice,of ,on ,or ,owner,permission,"
    "protect,resulting,right,statement,status,term,the library,the software,to ,treat,under ,which "
).split(",")
ITEMS = "a ,all ,an ,and ,any ,as ,each ,every ,for ,if ,in ,it ,no ,of ,or ,such ,that ,the ,this ,to ,under ,when ,where ,with ,you ,your ".split(",")
COPYRIGHT_LINE = (
    r"(^|\n)[ \t*#/;%-]*(copyright[ \t:,-]*([0-9]{4}|\(c\)|©)|copyright[ \t:]+" + _unlike(NO_HOLDERS, r" \t:,.;)/'\-")
    + r"|\(c\)[^\n]*(19|20)[0-9]{2}|\(c\)[ \t]*" + _unlike(ITEMS, r" \t") + r"|©)[^\n]*"
)

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
    "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE "
    "FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION "
    "WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_GRANT = (
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
)
_ISC_WARRANTY = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
    "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER "
    "TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
# Public licence texts and the notices that stand for one.
KNOWN = [
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
        "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do "
        "so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software. " + _AS_IS,
    ),
    ("ISC", f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_WARRANTY}"),
    ("0BSD", f"{_ISC_GRANT}. {_ISC_WARRANTY}"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
]
_MIT, _ISC, _0BSD = (text for _, text in KNOWN[:3])
FOLDER = files(__package__) / "licence_texts"  # verbatim public texts
_ADDRESS = r"51 Franklin Street, Fifth Floor, Boston, MA +02110-1301,? +USA"
ADDRESSES = ["59 Temple Place, Suite 330, Boston, MA 02111-1307 USA", "675 Mass Ave, Cambridge, MA 02139, USA"]
_END = "END OF TERMS AND CONDITIONS"
_BSD = ["BSD License", "The BSD License"]
# licence: titles a text may have before it, where else it may begin, where else it may end
WHOLE = {
    "MIT": (["MIT License", "The MIT License", "MIT License (MIT)", "The MIT License (MIT)", "MIT"], [], []),
    "ISC": (["ISC License", "The ISC License", "ISC License (ISC)", "The ISC License (ISC)", "ISC"], [], []),
    "0BSD": (["BSD Zero Clause License", "Zero-Clause BSD", "Zero-Clause BSD License", "BSD Zero Clause License (0BSD)", "Zero-Clause BSD (0BSD)", "0BSD"], [], []),
    "BSD-2-Clause": (["BSD 2-Clause License", "The BSD 2-Clause License", "BSD-2-Clause", 'BSD 2-Clause "Simplified" License', "Simplified BSD License", "FreeBSD License"] + _BSD, [], []),
    "BSD-3-Clause": (["BSD 3-Clause License", "The BSD 3-Clause License", "BSD-3-Clause", 'BSD 3-Clause "New" or "Revised" License', "New BSD License", "Modified BSD License"] + _BSD, [], []),
    "Zlib": (["zlib License", "The zlib License", "zlib/libpng License", "The zlib/libpng License"], [], []),
    "Unlicense": (["The Unlicense", "Unlicense", "The Unlicense (Unlicense)"], [], ["For more information"]),
    "Apache-2.0": ([], ["TERMS AND CONDITIONS FOR USE"], [_END, "APPENDIX: How to apply"]),
    "MPL-2.0": ([], ["1. Definitions"], ["Exhibit A - Source", "Exhibit B -"]),
    "GPL-2.0": ([], [" Copyright (C) 1989"], [_END, "How to Apply These Terms"]),
    "GPL-3.0": ([], [" Copyright (C) 2007"], [_END, "How to Apply These Terms"]),
    "LGPL-2.1": ([], [" Copyright (C) 1991"], [_END, "How to Apply These Terms"]),
    "LGPL-3.0": ([], [" Copyright (C) 2007"], []),
    "CC0-1.0": ([], ["CC0 1.0 Universal", "CREATIVE COMMONS CORPORATION IS NOT", "Statement of Purpose"], []),
    "CC-BY-SA-4.0": (
        ["Creative Commons"],
        ["Creative Commons Corporation", "Creative Commons Attribution-ShareAlike 4.0 International Public", "By exercising the Licensed Rights"],
        ["Creative Commons is not a party"],
    ),
}
NUMBERED = {"BSD-2-Clause", "BSD-3-Clause", "Zlib"}  # their items may have bullets instead
# licence: names that one-line notices give it
NAMES = {
    "MIT": ["MIT License", "MIT"],
    "ISC": ["ISC License"],
    "0BSD": ["BSD Zero Clause License", "0BSD License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "New BSD License", "Modified BSD License"],
    "Zlib": ["zlib License", "zlib/libpng License"],
    "Unlicense": ["Unlicense"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache License v2.0", "Apache 2.0 License", "Apache 2.0"],
    "MPL-2.0": ["Mozilla Public License, Version 2.0", "Mozilla Public License 2.0", "Mozilla Public License v2.0", "MPL 2.0"],
    "GPL-2.0": ["GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL v2", "GPLv2", "GPL-2.0 License"],
    "GPL-3.0": ["GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL v3", "GPLv3", "GPL-3.0 License"],
    "LGPL-2.1": ["GNU Lesser General Public License, version 2.1", "GNU Lesser General Public License v2.1", "GNU LGPL v2.1", "LGPLv2.1"],
    "LGPL-3.0": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License v3.0", "GNU LGPL v3", "LGPLv3"],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU Affero General Public License v3.0", "GNU AGPL v3", "AGPLv3"],
    "CC0-1.0": ["CC0 1.0", "CC0 1.0 Universal", "CC0 1.0 Universal License"],
    **{
        f"CC-{short}-4.0": [f"CC {short} 4.0", f"CC-{short}-4.0 License", *[f"Creative Commons {long} 4.0 {kind}" for kind in ("License", "International License")]]
        for short, long in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
OPENINGS = ["Released", "Licensed", "Distributed", "Available", *[f"This {x} is licensed" for x in ("work", "project", "software", "program", "library", "code", "file")], "This project is released"]


def _whole_texts() -> list[tuple[str, str]]:
    """Usual forms of the whole texts: with and without title, appendix and list numbers."""
    out = []
    for name, (titles, begins, ends) in WHOLE.items():
        inline = {"MIT": _MIT, "ISC": _ISC, "0BSD": _0BSD}.get(name)
        text = (FOLDER / f"{name}.txt").read_text(encoding="utf-8") if inline is None else inline
        texts = [text]
        if name in NUMBERED:
            texts.append(re.sub(r"(?m)^[ \t]*[0-9]\. ", "* ", text))
            texts += [f"All rights reserved.\n\n{t}" for t in texts]
        elif re.search(_ADDRESS, text):
            texts += [re.sub(_ADDRESS, a, text) for a in ADDRESSES]
            texts.append(re.sub(_ADDRESS, "", text, count=1))  # the address became a link in the copyright line
        for text in texts:
            starts = [0, *[text.index(x) for x in begins]]
            stops = [len(text), *[text.index(x, max(starts)) for x in ends]]
            if _END in ends:
                stops.append(text.index(_END) + len(_END))
            for form in (text[a:b] for a in starts for b in stops):
                out += [(name, form), *[(name, f"{t}\n\n{form}") for t in titles]]
    return out


def _notices() -> list[tuple[str, str]]:
    out = [(name, f"{o} under {the}{n}") for name, names in NAMES.items() for n in names for o in OPENINGS for the in ("", "the ", "a ")]
    ids = [(name, name) for name in NAMES] + [(f"{n}-{x}", f"{n}-{x}") for n in NAMES if "GPL" in n for x in ("only", "or-later")]
    return out + [(name, f"SPDX-License-Identifier: {i}") for name, i in ids]


KNOWN += [row for row in dict.fromkeys(_whole_texts() + _notices()) if row not in KNOWN]


def canonical(text: Column) -> Column:
    """The canonical form of a text."""
    low = F.lower(text)
    low = F.when(low.rlike(r"copyright|\(c\)|©"), F.regexp_replace(low, COPYRIGHT_LINE, "\n")).otherwise(low)
    spelt = low
    for other, one in SPELLINGS:
        spelt = F.replace(spelt, F.lit(other), F.lit(one))
    # Most texts hold none of the spellings; one look spares them the rest.
    low = F.when(low.rlike("|".join(other for other, _ in SPELLINGS)), spelt).otherwise(low)
    return F.trim(F.regexp_replace(low, r"[^\p{L}\p{N}]+", " "))


def with_digest(texts: DataFrame, text_col: str = "text", name: str = "digest") -> DataFrame:
    """``texts`` with the digest of the canonical form (replaces a column of that name)."""
    return texts.withColumn(name, F.md5(canonical(F.col(text_col))))


def known_digests(spark: SparkSession, known: DataFrame | None = None) -> DataFrame:
    """(digest, licence) of known licence texts (licence, text), each digest once."""
    if known is None:
        known = spark.createDataFrame(KNOWN, "licence string, text string")
    form = known.select("licence", canonical(F.col("text")).alias("form")).where("form <> ''")
    return form.groupBy(F.md5("form").alias("digest")).agg(F.min("licence").alias("licence"))


def scan(docs: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest, licence, notices): the licence a whole text is, and the
    sorted licences that whole lines of it are notices of."""
    table = broadcast_if_small(known_digests(docs.sparkSession, known))
    whole = with_digest(docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")), "_text")
    lines = docs.select(F.col(id_col).alias("_of"), F.explode(F.array_distinct(F.split(F.col(text_col), "\n"))).alias("_line"))
    noted = with_digest(lines, "_line").join(table, "digest").groupBy("_of").agg(F.array_join(F.array_sort(F.collect_set("licence")), ",").alias("notices"))
    out = whole.drop("_text").join(table, "digest", "left")
    out = out.join(noted.hint("merge"), out["_id"].eqNullSafe(noted["_of"]), "left")
    return out.select(F.col("_id").alias(id_col), "digest", "licence", F.coalesce("notices", F.lit("")).alias("notices"))
