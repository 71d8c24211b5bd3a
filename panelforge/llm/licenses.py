"""License scans: MinHash bands over overlapping windows retrieve templates, shingle containment verifies them.

DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelforge.llm.storage import ROW, numbered, stored, with_rows

SHINGLE = 5
#: (least shingles of a template, shingles of a window, shingles between the starts of windows, minima). Templates below the
#: first limit are found by windows of one shingle each, which meet for certain.
#: A window's signature are its shingles of least hash, each a band of one row; windows of a template lie at every shingle. A
#: document's and a template's window of n shingles that share c of them have a band in common for certain if n - c is less
#: than the minima, else with a probability of 1 - 2 * C(n - c, minima) / C(n, minima) or more. A template with a share LEAST
#: of its shingles in the document, cut in half by the windows, shares 5 of 12 with two windows, or 16 of 60: all bands miss
#: with a probability of (2 * 0.008) ** 2 = 2e-4 or (2 * 0.003) ** 2 = 4e-5 then, and hardly ever where a window lies better.
SCALES = ((10, 12, 8, 6), (40, 60, 48, 16))
LEAST = 0.8
#: Bytes of template text up to which the bands (about 16 bytes a byte of text) and the templates are broadcast.
TEMPLATE_BYTES = 16_000_000

# Short notices, standard headers and short licenses in full, as they stand in texts.
TEMPLATES = {
    "agpl-3.0": "This program is licensed under the GNU Affero General Public License, version 3.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "rights-reserved": "All rights reserved.",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "lgpl-3.0-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "epl-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "mit-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "isc-text": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "bsd-2-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "bsd-3-clause": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "zlib-text": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense-text": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "bsl-1.0-header": "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at https://www.boost.org/LICENSE_1_0.txt)",
    "cc0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "mit-notice": "Licensed under the MIT License.",
}


def words(text: str) -> Column:
    """Words after lower-casing A-Z: runs of a-z, digits and non-ASCII characters."""
    low = F.translate(F.coalesce(F.col(text), F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(low, "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def _shifted(x: Column, n: int) -> Column:
    return F.slice(x, n + 1, F.greatest(F.size(x) - n, F.lit(0)))


def with_shingles(df: DataFrame, sizes: list[int]) -> DataFrame:
    """df (with words) plus s<k> for each size: the hashes of all k-word shingles in order, by doubling."""
    need = {1} | set(sizes)
    for k in sorted(sizes, reverse=True):
        while k > 1:
            need |= {k // 2, k - k // 2}
            k = k - k // 2
    df = df.withColumn("s1", F.transform("words", lambda w: F.xxhash64(w)))
    for k in sorted(need - {1}):
        a, b = k // 2, k - k // 2
        tail = _shifted(F.col(f"s{b}"), a)
        pairs = F.zip_with(F.slice(F.col(f"s{a}"), 1, F.greatest(F.size(f"s{b}") - a, F.lit(0))), tail, lambda x, y: F.xxhash64(x, y))
        df = df.withColumn(f"s{k}", pairs)
    return df


def bands(shingles: Column, width: int, stride: int, minima: int) -> Column:
    """The signatures of all windows of width shingles, stride apart, one after the other. The last window may be shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(shingles) - (width - stride)), F.lit(stride))
    return F.flatten(F.transform(starts, lambda at: F.slice(F.sort_array(F.slice(shingles, at, width)), 1, minima)))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """(license_id, words, size): size is the template's shingle length, its word count if that is less."""
    rows = spark.createDataFrame(sorted(templates.items()), "license_id string, text string")
    return rows.select("license_id", words("text").alias("words")).filter("size(words) > 0").withColumn("size", F.least(F.lit(SHINGLE), F.size("words")))


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text", least: float = LEAST) -> DataFrame:
    """One row per document and license found in it: doc_id, license_id, n_shared, n_template, containment.

    A template is found in a document that holds a share `least` or more of its distinct five-word shingles
    (of a shorter template: its whole word sequence). Candidates are those of whose windows some signature
    meets that of one of the document's (SCALES); containment is then counted on the words
    themselves, over the whole document. Null and empty texts, and texts without a license, give no row;
    repeated rows give theirs once each. Without templates there are no rows. Other columns are not read.
    The templates are a parameter; their bands are joined to the documents', by broadcast up to TEMPLATE_BYTES of text.
    """
    spark = docs.sparkSession
    texts = TEMPLATES if templates is None else templates
    known = template_table(spark, texts)
    near = F.broadcast if sum(len(t or "") for t in texts.values()) <= TEMPLATE_BYTES else (lambda df: df)
    sizes = sorted({r["size"] for r in known.select("size").distinct().collect()}) or [SHINGLE]
    own = with_shingles(known, sizes)
    rows = numbered(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    hashed = with_shingles(rows.select(ROW, words("text").alias("words")), sizes).select(ROW, *[f"s{k}" for k in sizes])
    full, n = F.col(f"s{SHINGLE}"), F.size(f"s{SHINGLE}")
    least_of = [low for low, *_ in SCALES] + [1 << 30]
    mine, theirs = [], [F.col(f"s{k}") for k in sizes if k < SHINGLE]
    if SHINGLE in sizes:
        for (low, width, stride, minima), high in zip(SCALES, least_of[1:], strict=True):
            mine.append(F.when((F.col("size") == SHINGLE) & (n >= low) & (n < high), bands(full, width, 1, minima)))
            theirs.append(bands(full, width, stride, minima))
        theirs.append(full)
    mine += [F.when(F.col("size") == k, F.col(f"s{k}")) for k in sizes]
    index = own.select("license_id", F.explode(F.coalesce(*mine)).alias("band")).distinct()
    # explode() would add a filter that the optimizer copies, expression and all, below every projection
    met = hashed.select(ROW, F.explode_outer(F.concat(*theirs)).alias("band"))
    pairs = stored(met.join(near(index), "band").select(ROW, "license_id").distinct(), "candidates")
    found = with_rows(rows, pairs).select("doc_id", "license_id", words("text").alias("words"))
    candidates = found.join(near(known.select("license_id", F.col("words").alias("template"), "size")), "license_id")
    sequences = lambda col: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(col) - F.col("size") + 1, F.lit(1))), lambda i: F.array_join(F.slice(F.col(col), i, F.col("size")), " ")))
    counted = candidates.select("doc_id", "license_id", F.size(F.array_intersect(sequences("words"), sequences("template"))).cast("long").alias("n_shared"), F.size(sequences("template")).cast("long").alias("n_template"))
    return counted.withColumn("containment", F.col("n_shared") / F.col("n_template")).filter(F.col("containment") >= least)
