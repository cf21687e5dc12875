"""Standard notices end in their own families, unlisted ones as unknown; many notices in one text."""

import time

import pytest
from pyspark.sql import functions as F

from cuewright.llm import licences

GNU = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation, either version 3 of the License, or\n(at your option) any later version."
NOTICES = [
    ("agpl", GNU.format("Affero General Public License")),
    ("gpl", GNU.format("General Public License")),
    ("gpl", "GNU GPL v2"),
    ("lgpl", "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\nLicense as published by the Free Software Foundation"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
    ("epl", "This program and the accompanying materials are made\navailable under the terms of the Eclipse Public License 2.0\nwhich is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("mpl-1.1", 'The contents of this file are subject to the Mozilla Public License Version\n1.1 (the "License"); you may not use this file except in compliance with\nthe License.'),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("public-domain", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("public-domain", "This is free and unencumbered software released into the public domain."),
    ("bsd", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"),
    ("mit", "MIT License"),
    ("apache-2.0", "licensed under Apache 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a\nCreative Commons Attribution-ShareAlike 4.0 International License."),
    ("unknown", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("unknown", "Licensed under the Ruby License, version 2.0."),
    ("unknown", "Licensed under the GNU Free Documentation License, version 1.3"),
    ("unknown", "Licensed under the Apache Software License, Version 1.1."),
    ("unknown", "Released under the JSON License."),
    ("unknown", "Licensed under the Microsoft Public License (MS-PL)."),
    ("unknown", "Licensed under the W3C Software Notice and License."),
]


def test_families(spark):
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(NOTICES)], "i int, text string")
    got = {r.i: {x.family for x in r.s} for r in licences.scanned(rows, "s").collect()}
    assert {i: got[i] for i in got} == {i: {family} for i, (family, _) in enumerate(NOTICES)}


def test_hashes_are_spark_s(spark):
    """The vocabulary's slots are those that Spark's hash leads to."""
    rows = spark.createDataFrame([(g,) for g in licences.VOCABULARY], "g string").select("g", F.pmod(F.xxhash64("g"), F.lit(licences.SLOTS)).alias("h")).collect()
    slots = licences.slots()
    assert all({"g": r.g, "i": licences.PLACE[r.g]} in slots[r.h] for r in rows)


@pytest.mark.parametrize("gap", ["\n", "\nand some more words here\n"])
def test_many_notices_in_one_text(spark, gap):
    """Every notice counts once, and twice as many take about twice as long, not four times."""
    took = {}
    for n in (300, 1000, 2000):
        rows = spark.createDataFrame([(gap.join(["Licensed under the MIT License."] * n),)], "text string")
        began = time.perf_counter()
        assert licences.scanned(rows, "s").select(F.size("s")).first()[0] == n
        took[n] = time.perf_counter() - began
    assert took[2000] - took[300] < 3.2 * max(took[1000] - took[300], 2.0)


PLAIN = "the dog walked over a hill and slept in the sun for many hours "
SEVERAL = [
    (["mit", "apache-2.0"], "Released under the MIT License. Licensed under the Apache License, Version 2.0."),
    (["mit", "apache-2.0"], "dual licensed under the MIT License or the Apache License 2.0"),
    (["mit", "apache-2.0"], "dual licensed under the MIT License or\nthe Apache License 2.0"),
    (["gpl", "mit"], "SPDX-License-Identifier: GPL-3.0-or-later OR MIT"),
    (["cc-by", "cc-by-sa"], "Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0."),
    (["mit"] * 3, "Released under the MIT License. " * 3),
    (["reserved", "mit"], "Copyright. All rights reserved. Licensed under the MIT License."),
    (["gpl", "mit", "cc-by-nc"], f"{PLAIN * 30}This work is licensed under the GNU General Public License, version 3. Released under the MIT License. {PLAIN * 30}Licensed under CC BY-NC 4.0."),
    # More than whitespace, or other whitespace, between the words of an anchor.
    (["reserved"], "All rights  reserved."),
    (["reserved"], "All rights\r\nreserved."),
    (["public-domain"], " * This is free and unencumbered software released into the public\n * domain."),
    # Notices without an anchor.
    (["mit"], "is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    (["bsd"], "Use of this source code is governed by a BSD-style text"),
    # Words of names alone are nothing.
    ([], "Er kam mit dem Zug. " * 40),
    (["unknown"], "No licence at all here, a permission only"),
    (["mpl-1.1", "apache-2.0"], "The contents of this file are subject to the Mozilla Public License Version 1.1 (the License); you may not use this file except in compliance with the License.\nLicensed under the Apache License, Version 2.0."),
]


def test_nothing_left_out(spark):
    """All notices of a line count, and those without an anchor or with one in other spelling."""
    rows = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(SEVERAL)], "i int, text string")
    got = {r.i: sorted(x.family for x in r.s) for r in licences.scanned(rows, "s").collect()}
    assert got == {i: sorted(families) for i, (families, _) in enumerate(SEVERAL)}
