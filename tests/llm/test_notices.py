"""License notices as people write them, with the labels that they should get; none is made from the rules."""

from lorekeep.llm import licenses

NOTICES = {
    "This image is CC BY 2.0.": "cc-by-2.0",
    "Photo: CC BY-SA 3.0 via the archive": "cc-by-sa-3.0",
    "Licensed under CC BY 4.0": "cc-by-4.0",
    "Text is available under CC BY-NC-SA 2.5": "cc-by-nc-sa-2.5",
    "CC BY-ND": "cc-by-nd",
    "released under CC-BY": "cc-by",
    "Dedicated by CC0": "cc0-1.0",
    "Artistic License 1.0": "artistic-1.0",
    "the Artistic License 2.0 applies": "artistic-2.0",
    "Perl's Artistic License": "artistic",
    "licensed under CDDL 1.1": "cddl-1.1",
    "Released under the CDDL": "cddl",
    "Licensed under the EUPL 1.1": "eupl-1.1",
    "Licensed under the EUPL, version 1.2": "eupl-1.2",
    "Licensed under the EUPL": "eupl",
    "distributed under the OFL 1.1": "ofl-1.1",
    "GNU Affero General Public License version 3": "agpl-3.0",
    "the GNU Affero General Public License": "agpl",
    "Licensed under AGPLv3": "agpl-3.0",
    "GNU Lesser General Public License, version 2.1": "lgpl-2.1",
    "GNU Lesser General Public License v3": "lgpl-3.0",
    "licensed under the LGPL": "lgpl",
    "GNU General Public License, version 2": "gpl-2.0",
    "the GNU General Public License v3.0": "gpl-3.0",
    "Licensed under the GPL": "gpl",
    "Released under the GPLv2": "gpl-2.0",
    "licensed under the BSD license": "bsd",
    "Licensed under the BSD 3-Clause License": "bsd-3-clause",
    "New BSD License": "bsd-3-clause",
    "Simplified BSD license": "bsd-2-clause",
    "Boost Software License": "bsl-1.0",
    "Distributed under the Boost Software License, Version 1.0.": "bsl-1.0",
    "Licensed under either of Apache-2.0 or MIT": "apache-2.0,mit",
    "Licensed under either of Apache License, Version 2.0 or MIT license at your option": "apache-2.0,mit",
    "SPDX-License-Identifier: MIT OR Apache-2.0": "apache-2.0,mit",
    "SPDX-License-Identifier: (GPL-2.0 OR BSD-3-Clause)": "bsd-3-clause,gpl-2.0",
    "SPDX-License-Identifier: ISC": "isc",
    "SPDX-License-Identifier: Zlib": "zlib",
    "The Apache License": "apache",
    "Apache License, Version 2.0": "apache-2.0",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Mozilla Public License": "mpl",
    "Mozilla Public License Version 2.0": "mpl-2.0",
    "subject to the Mozilla Public License Version 1.1": "mpl-1.1",
    "licensed under MPL 2.0": "mpl-2.0",
    "Eclipse Public License - v 2.0": "epl-2.0",
    "Eclipse Public License": "epl",
    "The MIT License": "mit",
    "released under the MIT licence": "mit",
    "License: MIT": "mit",
    "This work is in the public domain.": "public-domain",
    "This work is not in the public domain.": "",
    "The text isn't in the public domain": "",
    "All rights reserved": "proprietary",
    "released under WTFPL": "wtfpl",
    "This is free and unencumbered under the Unlicense": "unlicense",
    "the PostgreSQL License": "postgresql",
    "he took the mit off his hand": "",
    "the apache helicopter landed": "",
    "a gpl of oil": "",
    "She holds a driving license": "",
    "boost your software": "",
    "creative commons are shared": "",
    "the general public was there": "",
    "version 2.0 of the plan": "",
}


def test_notices_as_people_write_them(spark):
    rows = list(enumerate(NOTICES))
    out = {r.doc_id: ",".join(sorted({f.label for f in r.found})) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {t: out[i] for i, t in rows} == NOTICES
