"""Licence labels of the notices as they stand in files."""

from quire.llm import license_scan

GNU = "This {what} is free software: you can redistribute it and/or modify\n * it under the terms of the GNU {name} as published by\n * the Free Software Foundation{end}"
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n1. Redistributions of source code must retain the above copyright notice.\n2. Redistributions in binary form must reproduce the above copyright notice.\n"
NOTICES = {
    "gpl,gpl-3.0": GNU.format(what="program", name="General Public License", end=", either version 3 of the License, or\n * (at your option) any later version."),
    "gpl,gpl-2.0": GNU.format(what="program", name="General Public License", end="; either version 2 of the License, or (at your option) any later version."),
    "lgpl-3.0": GNU.format(what="library", name="Lesser General Public License", end="; either version 3 of the License, or (at your option) any later version."),
    "bsd-3-clause": BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "bsd-2-clause": BSD,
    "lgpl-2.1": "This library is free software; you can redistribute it and/or\n# modify it under the terms of the GNU Lesser General Public\n# License as published by the Free Software Foundation; either\n# version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0": GNU.format(what="program", name="Affero General Public License", end=", either version 3 of the License, or (at your option) any later version."),
    "apache,apache-2.0": 'Licensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.',
    "mit-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public\n * License, v. 2.0. If a copy of the MPL was not distributed with this file",
    "gpl-2.0": "// SPDX-License-Identifier: GPL-2.0-or-later",
    "lgpl-2.1,mit": "/* SPDX-License-Identifier: MIT */ /* SPDX-License-Identifier: LGPL-2.1 */",
    "bsd-2-clause ": "# SPDX-License-Identifier: BSD-2-Clause",
    "": "The source and binary forms of the text met the general public; a license was published by the foundation, version 2.",
    "cc-by-nc-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
}


def test_standard_notices_get_their_label(spark):
    df = spark.createDataFrame(list(enumerate(NOTICES.values())), "doc_id long, text string")
    got = {r["doc_id"]: r["labels"] for r in license_scan.scan(df).collect()}
    assert [got[k] for k in range(len(NOTICES))] == [x.strip() for x in NOTICES]


def test_labels_do_not_depend_on_other_texts(spark):
    """Common licence words in the rest of the corpus change rarity, not labels."""
    rows = list(enumerate(NOTICES.values()))
    more = [(1000 + k, f"version {k} of the library is free software under the terms of the general foundation") for k in range(300)]
    alone = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    among = {r["doc_id"]: (r["labels"], r["score"]) for r in license_scan.scan(spark.createDataFrame(rows + more, "doc_id long, text string")).filter("doc_id < 1000").collect()}
    assert alone == among
