"""License scan by sentence rules, with DataFrame functions alone.

A text is split into sentences; each is normalised (A-Z lower-cased, every run of other
characters than a-z and 0-9 one blank, a list's number or letter in front left out) and
looked up among known licence sentences. A known sentence may have slots ``{}`` where files
name their own holders. A sentence that is unknown as a whole is looked up line by line,
since headings often lack a full stop; the full stop of ``Inc.`` and the like ends none where the sentence goes on. Lines of comment marks alone count as empty, and marks
at a line's start vanish with the other punctuation. The identifiers found, in the text's
order, form a sequence in which unknown sentences are gaps; licence rules are tried in their
order, each takes all its occurrences out of the sequence, where a gap stays too. A rule never
matches across a gap: a licence with a clause of its own isn't taken for the one without.

Defined cases: a null or empty text has no sentence and no licence; a licence is named
once, however often it occurs; what no rule takes is left in ``unmatched``; repeated
rows, null ids and extra columns pass through unchanged (working columns carry the
prefix ``__lic_``), but for columns named sentence_ids, licenses or unmatched, which the
results replace; an empty table gives an empty table. Texts of any length are read
whole; a slot holds ``HOLDER`` characters at most.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sentences of public licences, in the licences' own words.
SENTENCES: list[tuple[str, str]] = [
    ("ApacheShort", "Licensed under the Apache License, Version 2.0"),
    ("ApacheGrant", 'Licensed under the Apache License, Version 2.0 (the "License")'),
    ("ApacheUse", "you may not use this file except in compliance with the License"),
    ("ApacheCopy", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheCopyAt", "You may obtain a copy of the License at"),
    ("ApacheUrl", "http://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheUrl", "https://www.apache.org/licenses/LICENSE-2.0"),
    ("ApacheAsIs", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied'),
    ("ApacheSee", "See the License for the specific language governing permissions and limitations under the License"),
    ("MITShort", "Released under the MIT License"),
    ("MITShort", "Licensed under the MIT License"),
    ("MITPermission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("MIT0Permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so'),
    ("MITNotice", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("MITWarranty", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT'),
    ("MITLiability", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("JSONGood", "The Software shall be used for Good, not Evil"),
    ("X11Name", "Except as contained in this notice, the name of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}"),
    ("X11Name", "Except as contained in this notice, the names of {} shall not be used in advertising or otherwise to promote the sale, use or other dealings in this Software without prior written authorization from {}"),
    ("NCSAPermission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal with the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions'),
    ("NCSASource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimers"),
    ("NCSABinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimers in the documentation and/or other materials provided with the distribution"),
    ("ISCPermission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ISCPermission", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("ZeroPermission", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISCWarranty", 'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS'),
    ("ISCLiability", "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("GPL3Short", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL2Short", "This work is licensed under the GNU General Public License, version 2"),
    ("FreeSoftware", "This program is free software"),
    ("FreeLibrary", "This library is free software"),
    ("GPL3Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("GPL3Terms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3 of the License"),
    ("GPL2Later", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version"),
    ("GPLTerms", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("GPLTerms2", "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("EitherV2", "either version 2 of the License, or (at your option) any later version"),
    ("EitherV21", "either version 2.1 of the License, or (at your option) any later version"),
    ("EitherV3", "either version 3 of the License, or (at your option) any later version"),
    ("GPLHope", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("LibraryHope", "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY"),
    ("GPLImplied", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"),
    ("GPLSee", "See the GNU General Public License for more details"),
    ("GPLCopy", "You should have received a copy of the GNU General Public License along with this program"),
    ("LGPLTerms", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("LGPL3Later", "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("LGPLSee", "See the GNU Lesser General Public License for more details"),
    ("LGPLCopy", "You should have received a copy of the GNU Lesser General Public License along with this library"),
    ("AGPL3Later", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("AGPL3Terms", "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, version 3 of the License"),
    ("AGPLSee", "See the GNU Affero General Public License for more details"),
    ("AGPLCopy", "You should have received a copy of the GNU Affero General Public License along with this program"),
    ("GFDL13", "Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License, Version 1.3 or any later version published by the Free Software Foundation"),
    ("GFDLSections", "with no Invariant Sections, no Front-Cover Texts, and no Back-Cover Texts"),
    ("GFDLCopy", 'A copy of the license is included in the section entitled "GNU Free Documentation License"'),
    ("BSDGrant", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSDSource", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"),
    ("BSDBinary", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("BSDAdvertising", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
    ("BSDAcknowledgement", "This product includes software developed by {}"),
    ("BSDEndorse", "Neither the name of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "Neither the name of {} nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "Neither the names of {} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "Neither the names of {} nor the names of their contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "The name of {} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDEndorse", "The names of {} may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("BSDWarranty", 'THIS SOFTWARE IS PROVIDED BY {} "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED'),
    ("ZlibAsIs", "This software is provided 'as-is', without any express or implied warranty"),
    ("ZlibLiability", "In no event will the authors be held liable for any damages arising from the use of this software"),
    ("ZlibPermission", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions"),
    ("ZlibOrigin", "The origin of this software must not be misrepresented"),
    ("ZlibClaim", "you must not claim that you wrote the original software"),
    ("ZlibCredit", "If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required"),
    ("ZlibCredit", "If you use this software in a product, an acknowledgement in the product documentation would be appreciated but is not required"),
    ("ZlibAltered", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software"),
    ("ZlibNotice", "This notice may not be removed or altered from any source distribution"),
    ("BSLPermission", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("BSLShort", "Distributed under the Boost Software License, Version 1.0"),
    ("UnlicenseFree", "This is free and unencumbered software released into the public domain"),
    ("UnlicenseAnyone", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("WTFPLWarranty", "It comes without any warranty, to the extent permitted by applicable law"),
    ("WTFPLRedistribute", "You can redistribute it and/or modify it under the terms of the Do What The Fuck You Want To Public License, Version 2, as published by Sam Hocevar"),
    ("MPL2", "This Source Code Form is subject to the terms of the Mozilla Public License, v"),
    ("MPL11", 'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License")'),
    ("MPLUrl", "You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("EPL1Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("EPL2Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL2Terms", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0 which accompanies this distribution, and is available at https://www.eclipse.org/legal/epl-v20.html"),
    ("CDDL1Terms", 'The contents of this file are subject to the terms of the Common Development and Distribution License (the "License")'),
    ("EUPL12", "Licensed under the EUPL, Version 1.2 or - as soon they will be approved by the European Commission - subsequent versions of the EUPL (the \"Licence\")"),
    ("EUPL12Short", "Licensed under the EUPL-1.2"),
    ("EUPL12Short", "Licensed under the EUPL, Version 1.2"),
    ("PostgreSQLPermission", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies"),
    ("ArtisticTerms2", "you can redistribute it and/or modify it under the terms of the Artistic License 2.0"),
    ("CCBY4", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CCBY4", "This work is licensed under the Creative Commons Attribution 4.0 International License"),
    ("CCBY4", "Licensed under CC BY 4.0"),
    ("CCBYSA4", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("CCBYSA4", "Licensed under CC BY-SA 4.0"),
    ("CCBYSA3", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("CCBYSA3", "Licensed under CC BY-SA 3.0"),
    ("CCBYNC4", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CCBYNC4", "Licensed under CC BY-NC 4.0"),
    ("CCBYND4", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("CCBYND4", "Licensed under CC BY-ND 4.0"),
    ("CCBYNCSA4", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("CCBYNCSA4", "Licensed under CC BY-NC-SA 4.0"),
    ("CCBYNCND4", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("CCBYNCND4", "Licensed under CC BY-NC-ND 4.0"),
    ("CC0", "This work is dedicated to the public domain under the CC0 1.0 Universal license"),
]
#: Ordered rules: a licence and the sequence of identifiers that states it; one with a question mark may be missing. Longer statements come first.
RULES: list[tuple[str, list[str]]] = [
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopyAt", "ApacheUrl", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheSee"]),
    ("Apache-2.0", ["ApacheGrant", "ApacheUse"]),
    ("Apache-2.0", ["ApacheShort"]),
    ("JSON", ["MITPermission", "MITNotice", "JSONGood", "MITWarranty", "MITLiability?"]),
    ("X11", ["MITPermission", "MITNotice", "MITWarranty", "MITLiability", "X11Name"]),
    ("MIT", ["MITPermission", "MITNotice", "MITWarranty", "MITLiability?"]),
    ("MIT-0", ["MIT0Permission", "MITWarranty", "MITLiability"]),
    ("MIT", ["MITShort"]),
    ("NCSA", ["NCSAPermission", "NCSASource", "NCSABinary"]),
    ("ISC", ["ISCPermission", "ISCWarranty", "ISCLiability"]),
    ("ISC", ["ISCPermission"]),
    ("0BSD", ["ZeroPermission", "ISCWarranty", "ISCLiability"]),
    ("GPL-3.0-or-later", ["FreeSoftware", "GPL3Later", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-or-later", ["GPL3Later", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-or-later", ["FreeSoftware", "GPLTerms", "EitherV3", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-or-later", ["GPL3Later"]),
    ("GPL-3.0-only", ["GPL3Terms", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-3.0-only", ["GPL3Terms"]),
    ("GPL-2.0-or-later", ["FreeSoftware", "GPLTerms", "EitherV2", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["FreeSoftware", "GPL2Later", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["GPL2Later", "GPLHope", "GPLImplied", "GPLSee", "GPLCopy"]),
    ("GPL-2.0-or-later", ["GPLTerms", "EitherV2"]),
    ("GPL-2.0-or-later", ["GPL2Later"]),
    ("GPL-2.0-only", ["FreeSoftware", "GPLTerms2"]),
    ("GPL-2.0-only", ["GPLTerms2"]),
    ("GPL-3.0-only", ["GPL3Short"]),
    ("GPL-2.0-only", ["GPL2Short"]),
    ("LGPL-2.1-or-later", ["FreeLibrary", "LGPLTerms", "EitherV21", "LibraryHope", "GPLImplied", "LGPLSee", "LGPLCopy"]),
    ("LGPL-2.1-or-later", ["LGPLTerms", "EitherV21"]),
    ("LGPL-3.0-or-later", ["LGPLTerms", "EitherV3"]),
    ("LGPL-3.0-or-later", ["LGPL3Later"]),
    ("AGPL-3.0-or-later", ["FreeSoftware", "AGPL3Later", "GPLHope", "GPLImplied", "AGPLSee", "AGPLCopy"]),
    ("AGPL-3.0-or-later", ["AGPL3Later"]),
    ("AGPL-3.0-only", ["AGPL3Terms"]),
    ("GFDL-1.3-or-later", ["GFDL13", "GFDLSections", "GFDLCopy"]),
    ("GFDL-1.3-or-later", ["GFDL13"]),
    ("BSD-4-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDAdvertising", "BSDAcknowledgement?", "BSDEndorse", "BSDWarranty"]),
    ("BSD-3-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDEndorse", "BSDWarranty"]),
    ("BSD-2-Clause", ["BSDGrant", "BSDSource", "BSDBinary", "BSDWarranty"]),
    ("BSD-1-Clause", ["BSDGrant", "BSDSource", "BSDWarranty"]),
    ("Zlib", ["ZlibAsIs", "ZlibLiability", "ZlibPermission", "ZlibOrigin", "ZlibClaim", "ZlibCredit?", "ZlibAltered", "ZlibNotice"]),
    ("BSL-1.0", ["BSLPermission"]),
    ("BSL-1.0", ["BSLShort"]),
    ("Unlicense", ["UnlicenseFree", "UnlicenseAnyone"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("WTFPL", ["FreeSoftware", "WTFPLWarranty", "WTFPLRedistribute"]),
    ("WTFPL", ["WTFPLRedistribute"]),
    ("MPL-2.0", ["MPL2"]),
    ("MPL-1.1", ["MPL11", "ApacheUse", "MPLUrl"]),
    ("MPL-1.1", ["MPL11"]),
    ("EPL-1.0", ["EPL1Terms"]),
    ("EPL-2.0", ["EPL2Terms"]),
    ("CDDL-1.0", ["CDDL1Terms"]),
    ("EUPL-1.2", ["EUPL12"]),
    ("EUPL-1.2", ["EUPL12Short"]),
    ("PostgreSQL", ["PostgreSQLPermission"]),
    ("Artistic-2.0", ["FreeSoftware", "ArtisticTerms2"]),
    ("CC-BY-4.0", ["CCBY4"]),
    ("CC-BY-SA-4.0", ["CCBYSA4"]),
    ("CC-BY-SA-3.0", ["CCBYSA3"]),
    ("CC-BY-NC-4.0", ["CCBYNC4"]),
    ("CC-BY-ND-4.0", ["CCBYND4"]),
    ("CC-BY-NC-SA-4.0", ["CCBYNCSA4"]),
    ("CC-BY-NC-ND-4.0", ["CCBYNCND4"]),
    ("CC0-1.0", ["CC0"]),
]
#: A full stop and the like, or an empty line; a line of comment marks alone is empty.
SENTENCE_END = r"[.;:!?]+(?:[\x20\x09-\x0D]+|\z)|\n[\x20\x09\x0D#*/%-]*\n"
#: A company's abbreviation whose full stop doesn't end a sentence, for it goes on in small letters, marks or AND.
ABBREVIATION = r"((?i:\b(?:inc|corp|ltd|co|llc)))\.([\x20\x09-\x0D]+(?:[^A-Z\x20\x09-\x0D]|AND\b))"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


_MARK = "^(?:[0-9]{1,2}|[a-d]|i{1,3})(?: |$)"
#: Stands for unknown sentences, and where a rule took its identifiers.
GAP = "|"
SLOT = "{}"
#: Most characters that the slots of a sentence hold together.
HOLDER = 200


def normal(sentence: str) -> str:
    return re.sub(_MARK, "", re.sub("[^a-z0-9]+", " ", sentence.translate(str.maketrans(_UPPER, _LOWER))).strip(" "))


def _normal(sentence: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(F.translate(sentence, _UPPER, _LOWER), "[^a-z0-9]+", " ")), _MARK, "")


def _forms(sentences: list[tuple[str, str]]) -> tuple[dict[str, str], dict[str, str]]:
    """Normal sentence -> identifier, and for those with slots, pattern of LIKE -> identifier."""
    plain = {normal(s): i for i, s in sentences if SLOT not in s}
    slots = {" % ".join(filter(None, map(normal, s.split(SLOT)))) + " %" * s.endswith(SLOT): i for i, s in sentences if SLOT in s}
    return plain, slots


def hints(sentences: list[tuple[str, str]]) -> list[str]:
    """Words of which each sentence holds one at least, so that a text without them needs no splitting: each time the word that most sentences hold, long ones first of all."""
    left = [{w for part in s.split(SLOT) for w in normal(part).split()} for _, s in sentences]
    left = [({w for w in words if len(w) > 5} or words) for words in left]
    out = []
    while left := [words for words in left if words]:
        count = Counter(w for words in left for w in words)
        out.append(min(count, key=lambda w: (-count[w], w)))
        left = [words for words in left if out[-1] not in words]
    return out


def marked_sentences(text: Column, sentences: list[tuple[str, str]] = SENTENCES) -> Column:
    """The identifiers of a text's known sentences, in its order, and a gap for each unknown one."""
    plain, slots = _forms(sentences)
    known = F.create_map(*[F.lit(x) for k, v in plain.items() for x in (k, v)]) if plain else F.create_map().cast("map<string, string>")

    def identify(words: Column) -> Column:
        held = [F.when(words.like(p) & (F.length(words) <= len(p) + HOLDER), F.lit(i)) for p, i in slots.items()]
        return F.coalesce(F.try_element_at(known, words), *held)

    def of_lines(part: Column) -> Column:
        found = F.transform(F.transform(F.split(part, "\n"), _normal), lambda w: F.when(w != "", F.coalesce(identify(w), F.lit(GAP))))
        return F.filter(found, lambda x: x.isNotNull())

    def of(part: Column) -> Column:
        whole = F.transform(F.array(_normal(part)), identify)  # in an array, so that it is evaluated once
        return F.element_at(F.transform(whole, lambda i: F.when(i.isNotNull(), F.array(i)).otherwise(of_lines(part))), 1)

    whole = F.regexp_replace(text, ABBREVIATION, "$1$2")
    found = F.flatten(F.transform(F.split(whole, SENTENCE_END), of))
    return F.when(text.rlike("(?i)" + "|".join(hints(sentences))), found).otherwise(F.array().cast("array<string>"))


def sentence_ids(text: Column, sentences: list[tuple[str, str]] = SENTENCES) -> Column:
    """The identifiers of the known sentences of a text, in its order."""
    return F.filter(marked_sentences(text, sentences), lambda x: x != GAP)


def _pattern(identifiers: list[str]) -> str:
    return "".join(f"(?:<{i[:-1]}>)?" if i.endswith("?") else f"<{i}>" for i in identifiers)


def match_rules(marked: Column, rules: list[tuple[str, list[str]]] = RULES) -> Column:
    """Struct of what no rule took (tagged identifiers in a row) and the licences found, in the rules' order."""
    tagged = F.transform(marked, lambda x: F.when(x == GAP, x).otherwise(F.concat(F.lit("<"), x, F.lit(">"))))
    ordered = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_pattern(ids)).alias("pattern")) for name, ids in rules])
    start = F.struct(F.concat(F.lit(""), F.array_join(tagged, "")).alias("rest"), F.array().cast("array<string>").alias("found"))

    def step(held: Column, rule: Column) -> Column:
        left = F.regexp_replace(held["rest"], rule["pattern"], F.lit(GAP))
        found = F.when(left != held["rest"], F.array_union(held["found"], F.array(rule["name"]))).otherwise(held["found"])
        return F.struct(left.alias("rest"), found.alias("found"))

    return F.aggregate(ordered, start, step, lambda held: F.struct(F.replace(held["rest"], F.lit(GAP), F.lit("")).alias("rest"), held["found"].alias("found")))


def scan(docs: DataFrame, sentences: list[tuple[str, str]] = SENTENCES, rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """docs with sentence_ids, licenses (arrays) and unmatched (string)."""
    marked = docs.withColumn("__lic_ids", marked_sentences(F.coalesce(F.col("text"), F.lit("")), sentences))
    none = F.struct(F.lit("").alias("rest"), F.array().cast("array<string>").alias("found"))
    known = F.filter("__lic_ids", lambda x: x != GAP)
    matched = marked.withColumn("__lic_hit", F.when(F.exists("__lic_ids", lambda x: x != GAP), match_rules(F.col("__lic_ids"), rules)).otherwise(none))
    return matched.withColumns({"sentence_ids": known, "licenses": F.col("__lic_hit.found"), "unmatched": F.col("__lic_hit.rest")}).drop("__lic_ids", "__lic_hit")


def scan_sql() -> str:
    """The same over the table documents, in DuckDB's SQL: a step per rule."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    plain, slots = _forms(SENTENCES)
    known = ", ".join(f"({quoted(k)}, {quoted(v)})" for k, v in plain.items())
    clean = lambda x: f"regexp_replace(trim(regexp_replace(translate({x}, '{_UPPER}', '{_LOWER}'), '[^a-z0-9]+', ' ', 'g')), '{_MARK}', '')"
    held = "CASE " + " ".join(f"WHEN words LIKE {quoted(p)} AND len(words) <= {len(p) + HOLDER} THEN {quoted(i)}" for p, i in slots.items()) + " END"
    steps, last = [], "r0"
    for k, (name, ids) in enumerate(RULES, 1):
        pattern = quoted(_pattern(ids))
        named = f"CASE WHEN regexp_matches(rest, {pattern}) AND NOT list_contains(found, {quoted(name)}) THEN list_append(found, {quoted(name)}) ELSE found END"
        steps.append(f"r{k} AS (SELECT rn, doc_id, n, {named} AS found, regexp_replace(rest, {pattern}, '{GAP}', 'g') AS rest FROM {last})")
        last = f"r{k}"
    return f"""
WITH known(sentence, id) AS (VALUES {known}),
d AS (SELECT row_number() OVER () AS rn, doc_id, regexp_replace(coalesce(text, ''), '{ABBREVIATION}', '\\1\\2', 'g') AS text FROM documents),
s AS (SELECT rn, unnest(regexp_split_to_array(text, '{SENTENCE_END}')) AS part, generate_subscripts(regexp_split_to_array(text, '{SENTENCE_END}'), 1) AS i FROM d),
c AS (SELECT *, {clean('part')} AS words FROM s),
w AS (SELECT c.*, coalesce(k.id, {held}) AS whole FROM c LEFT JOIN known k ON k.sentence = words),
l AS (SELECT rn, i, unnest(string_split(part, chr(10))) AS line, generate_subscripts(string_split(part, chr(10)), 1) AS j FROM w WHERE whole IS NULL),
m AS (SELECT rn, i, j, {clean('line')} AS words FROM l),
f AS (SELECT rn, i, 0 AS j, whole AS id FROM w WHERE whole IS NOT NULL
      UNION ALL SELECT rn, i, j, coalesce(k.id, {held}, '{GAP}') FROM m LEFT JOIN known k ON k.sentence = words WHERE words <> ''),
a AS (SELECT rn, count(*) FILTER (id <> '{GAP}') AS n, string_agg(CASE WHEN id = '{GAP}' THEN id ELSE '<' || id || '>' END, '' ORDER BY i, j) AS rest FROM f GROUP BY rn),
r0 AS (SELECT d.rn, d.doc_id, coalesce(n, 0)::BIGINT AS n, []::VARCHAR[] AS found, coalesce(rest, '') AS rest FROM d LEFT JOIN a ON a.rn = d.rn),
{", ".join(steps)}
SELECT doc_id, n AS n_sentences, array_to_string(found, ',') AS licenses, replace(rest, '{GAP}', '') AS unmatched FROM {last}
"""
