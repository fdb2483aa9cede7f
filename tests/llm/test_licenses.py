import duckdb

from docloom.llm import licenses

MIT = "Released under the MIT License."


def test_own_and_inherited(spark):
    rows = [
        ("a/LICENSE", "MIT License\n\n" + licenses.TEMPLATES["MIT"][1]), ("a/x.py", "code"), ("a/b/c/y.py", "# Licensed under the Apache License, Version 2.0.\ncode"),
        ("a/b/c/z.py", "no notice"), ("a/b/LICENSE.txt", licenses.TEMPLATES["GPL-3.0"][0]), ("d/w.py", "Copyright someone"), ("LICENSE", licenses.TEMPLATES["CC-BY-NC-4.0"][0]),
        (None, MIT), ("e/v.py", None), ("e/v.py", ""), ("a/x.py", "code"), ("ab/u.py", ""),
    ]
    df = spark.createDataFrame([(p, t, "x") for p, t in rows], "path string, text string, term string").repartition(3)
    found = licenses.scan(df).collect()
    assert len(found) == len(rows)
    got = {r.path: (r.own_license, r.license, r.inherited_from) for r in found}
    assert got["a/x.py"] == (None, "MIT", "a/LICENSE")
    assert got["a/b/c/y.py"] == ("Apache-2.0", "Apache-2.0", None)
    assert got["a/b/c/z.py"] == (None, "GPL-3.0", "a/b/LICENSE.txt")
    assert got["d/w.py"] == (None, "CC-BY-NC-4.0", "LICENSE") and got["ab/u.py"] == got["d/w.py"] == got["e/v.py"]
    assert got[None] == ("MIT", "MIT", None)
    assert licenses.scan(df.limit(0)).count() == 0


def test_matches_sql(spark, odd_texts):
    texts = odd_texts + [(20, MIT), (21, "word " * 100 + "\n" + MIT), (22, "Licensed under CC BY-NC 4.0."), (23, "license"), (24, "x " * 50), (25, MIT)]
    rows = [(i, t, "en" if (i or 0) % 2 else None, f"src{(i or 0) % 3}" if i else None) for i, t in texts]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    df = df.where("doc_id is not null").distinct()
    con = duckdb.connect()
    table = df.toArrow()
    con.register("documents", table)
    want = con.execute(licenses.document_sql())
    columns = [d[0] for d in want.description]
    found = licenses.scan(licenses.document_paths(df), keep=["doc_id"]).select(*columns)
    assert sorted(map(tuple, found.collect()), key=repr) == sorted(want.fetchall(), key=repr)


def test_every_template_is_nearest_to_itself(spark):
    rows = [(i, name, text) for i, (name, text) in enumerate((n, t) for n, own in licenses.TEMPLATES.items() for t in own)]
    df = spark.createDataFrame([(str(i), text) for i, _, text in rows], "path string, text string")
    found = {r.path: r.own_license for r in licenses.scan(df).collect()}
    assert all(found[str(i)] == name for i, name, _ in rows)


def test_notices_inside_of_lines_and_wrapped(spark):
    rows = [
        ("MIT", "Copyright (c) 2020 John Doe. Released under the MIT License. All rights reserved."),
        ("MIT", "The weather was fine that day and we went out. Released under the MIT License. Nothing else of note happened then."),
        ("GPL-3.0", "x " * 500 + "This work is licensed under the GNU\n# General Public License, version 3 and " + "y " * 500),
        (None, "Copyright 2020 by the people of the town, who need a license to fish"),
    ]
    df = spark.createDataFrame([(str(i), text) for i, (_, text) in enumerate(rows)], "path string, text string")
    found = {r.path: (r.own_license, r.own_score) for r in licenses.scan(df).collect()}
    assert [found[str(i)][0] for i in range(len(rows))] == [name for name, _ in rows]
    assert all(found[str(i)][1] == 1 for i in range(3))


GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation, either version {} of the License, or (at your option) any later version."
NOTICES = [
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("AGPL-3.0-or-later", GNU.format("Affero General Public License", 3).replace(" the ", "\n * the ")),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.'),
    ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS"),
    ("BSD-2-Clause", "Copyright (c) 2019, X\n\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:\n\n1. Redistributions of source code must retain the above copyright notice"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n3. Neither the name of X nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-3-Clause", "// Use of this source code is governed by a BSD-style\n// license that can be found in the LICENSE file."),
    ("CC-BY-3.0", "This text is licensed under CC BY 3.0."), ("CC-BY-4.0", "licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"), ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0"), ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0"),
    ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."), ("CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0"),
    (None, "Licensed under CC BY-SA 2.5"), ("CC0-1.0", "Creative Commons Legal Code\n\nCC0 1.0 Universal\n\n    CREATIVE COMMONS CORPORATION IS NOT A LAW FIRM"),
    ("GPL-1.0", "GNU GENERAL PUBLIC LICENSE Version 1, February 1989"), ("GPL-2.0", "                    GNU GENERAL PUBLIC LICENSE\n                       Version 2, June 1991\n\n Copyright (C) 1989, 1991 Free Software Foundation, Inc." + "\n" + GNU.format("General Public License", 2)),
    ("GPL-2.0-or-later", "GNU General Public License version 2 or later"), ("GPL-2.0-or-later", "# SPDX-License-Identifier: GPL-2.0-or-later"), ("GPL-3.0-or-later", "# " + GNU.format("General Public License", 3)),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n13. Use with the GNU Affero General Public License.\nunder version 3 of the GNU Affero General Public License into a single combined work"),
    ("LGPL-2.1", "Distributed under the GNU Lesser General Public License, version 2.1"), ("LGPL-2.1-or-later", GNU.format("Lesser General Public License", "2.1")), ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007"),
    ("MIT", "MIT License\n\nPermission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files"),
    ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1.12. Secondary License means either the GNU General Public License, Version 2.0, the GNU Lesser General Public License, Version 2.1, the GNU Affero General Public License, Version 3.0"),
    ("GPL-3.0", "GNU General Public License v3.0"), ("GPL-3.0", "Released under the GPL v3."), ("GPL-2.0", "GPL version 2"), ("LGPL-2.1", "GNU Lesser General Public License v2.1"), ("LGPL-2.1", "under LGPL version 2.1 only"),
    ("GPL-2.0-or-later", "GNU General Public License v2.0 or later"), ("AGPL-3.0", "Distributed under the AGPL v3"), ("MPL-1.1", "Mozilla Public License 1.1"), ("MPL-2.0", "MPL: Mozilla Public License v2.0"),
    ("SSPL-1.0", "Server Side Public License, version 1"), ("SSPL-1.0", "licensed under the Server Side Public License v1"), ("BUSL-1.1", "Business Source License 1.1"), ("Elastic-2.0", "Elastic License 2.0"),
    ("Apache-2.0 WITH Commons-Clause", "Apache License, Version 2.0, with Commons Clause"), ("Apache-2.0 WITH Commons-Clause", "Licensed under the Apache License, Version 2.0 with the Commons Clause condition".replace("the Commons", "Commons")),
    (None, "This file is not licensed under the MIT License."), (None, "It is not released under the GNU General Public License, version 2"), (None, "Confluent Community License 1.1"), (None, "Prosperity Public License 3.0.0"),
    ("Apache-2.0", "Apache License v2.0"), ("MIT", "Released under the MIT License (we do not charge for it)"), (None, "The library of the town gives a general license to the public, as of version 3"), (None, "GNU Library General Public License, version 2"),
]


def test_notices_are_not_taken_for_variants(spark):
    df = spark.createDataFrame([(f"{i}/LICENSE", text) for i, (_, text) in enumerate(NOTICES)], "path string, text string")
    found = {r.path: r.own_license for r in licenses.scan(df).collect()}
    assert [(NOTICES[i][1][:60], found[f"{i}/LICENSE"]) for i in range(len(NOTICES))] == [(text[:60], name) for name, text in NOTICES]


def test_qualifiers():
    assert licenses.qualifiers(["gpl", "v2.0", "or", "later", "nc", "2004", "12.10"]) == "12.10 2 later noncommercial"
