"""Fixed values of the licence classifier: names, sentences and statements about licences."""

# Names of the licences of every family, as notices write them.
NAMES = {
    "MIT": ["MIT License", "MIT licence", "Expat License", "MIT"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache-2.0", "Apache 2.0 License"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-clause BSD license", "Simplified BSD License", "BSD-2-Clause"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-clause BSD license", "New BSD License", "BSD-3-Clause"],
    "GPL-2.0": [
        "GNU General Public License, version 2", "GNU General Public License v2.0", "GNU GPL version 2", "GPLv2",
        "GPL-2.0-only",
    ],
    "GPL-3.0": [
        "GNU General Public License, version 3", "GNU General Public License v3.0", "GNU GPL version 3", "GPLv3",
        "GPL-3.0-or-later",
    ],
    "LGPL": [
        "GNU Lesser General Public License, version 3", "GNU Lesser General Public License version 2.1", "LGPLv3",
        "LGPL-2.1-or-later",
    ],
    "AGPL-3.0": ["GNU Affero General Public License, version 3", "GNU AGPL version 3", "AGPLv3", "AGPL-3.0-only"],
    "MPL-2.0": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0"],
    "ISC": ["ISC License", "ISC licence", "ISC"],
    "Unlicense": ["The Unlicense", "Unlicense"],
    "CC0-1.0": ["CC0 1.0 Universal", "Creative Commons Zero 1.0", "CC0-1.0"],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International License", "CC BY 4.0", "CC-BY-4.0"],
    "CC-BY-SA-4.0": [
        "Creative Commons Attribution-ShareAlike 4.0 International License", "CC BY-SA 4.0", "CC-BY-SA-4.0",
    ],
    "CC-BY-NC-4.0": [
        "Creative Commons Attribution-NonCommercial 4.0 International License", "CC BY-NC 4.0", "CC-BY-NC-4.0",
    ],
}

# Ways in which notices name a licence.
NOTICES = [
    "{}", "Licensed under the {}.", "Licensed under {}.", "Released under the {}.", "Released under {}.",
    "This work is licensed under the {}.", "This work is licensed under a {}.", "Distributed under the {}.",
    "This project is licensed under the terms of the {}.", "SPDX-License-Identifier: {}", "License: {}",
    "Published under the {}, see the LICENSE file.", "This file is available under the {}.",
    "The source code is made available under the {}.", "All content is licensed under {} unless noted otherwise.",
]

# Those of them that grant nothing in words: a name with a label at most.
LABELS = ["{}", "License: {}", "SPDX-License-Identifier: {}"]

# Sentences of the licences and of the notices that they ask for.
SENTENCES = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
        "associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "The above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the Software.",
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED "
        "TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    ],
    "Apache-2.0": [
        "Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual, "
        "worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is "
        "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0",
    ],
    "BSD-2-Clause": [
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
        "following disclaimer.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
        "the following conditions are met",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
        "following disclaimer in the documentation and/or other materials provided with the distribution.",
    ],
    "BSD-3-Clause": [
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission.",
    ],
    "GPL-3.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "GPL-2.0": [
        "it under the terms of the GNU General Public License as published by the Free Software Foundation; either "
        "version 2 of the License, or (at your option) any later version.",
    ],
    "LGPL": [
        "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; "
        "either version 2.1 of the License, or (at your option) any later version.",
    ],
    "AGPL-3.0": [
        "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "CC0-1.0": [
        "To the extent possible under law, the person who associated CC0 with this work has waived all copyright and "
        "related or neighboring rights to this work.",
    ],
    "CC-BY-4.0": [
        "you are free to share and adapt the material for any purpose, even commercially, as long as you give "
        "appropriate credit, provide a link to the license, and indicate if changes were made",
    ],
}

# Statements with the words of licences that grant none.
OTHERS = [
    "All rights reserved.", "Copyright 2019 the authors. All rights reserved.", "A driving license is required.",
    "You need a valid license to operate this machine.", "The license plate was stolen.",
    "Please ask for permission before you copy this page.", "The commission renewed the broadcasting licence.",
    "He lost his licence after the accident.", "The warranty covers parts and labour for two years.",
    "Redistribution of wealth was the topic of the debate.", "See the license agreement for details.",
    "By using this product you accept the end user license agreement.", "This is proprietary software.",
    "The license server could not be reached.", "Your license key has expired, please renew it.",
    "The Apache people live in the southwest.", "She studies at MIT.", "The creative commons room is on the left.",
    "Mozilla released a new browser.", "The fishing license costs ten dollars.",
    "The public domain debate goes on.", "Copyright law protects authors.", "No warranty is given.",
    "The software is provided by the vendor.", "Free software matters to many users.",
    "The hotel is licensed to sell alcohol.", "A licensed electrician must do this work.",
    "The project has no license yet.", "We license our patents to partners.", "Terms and conditions apply.",
    "The version 2.0 of the product is out.", "Version 3 was released in May.", "The gnu is an antelope.",
    "The source code is not available.", "This content is for members only.", "Permission denied.",
    "The above notice was removed.", "The distribution of the species is wide.", "The ISC met in May.",
    "Licensed under the Eclipse Public License 2.0.", "Distributed under the Artistic License 2.0.",
    "Released under the zlib License.", "Licensed under the Boost Software License, Version 1.0.",
    "Licensed under the European Union Public Licence 1.2.", "Released under the WTFPL.",
    "This work is licensed under the Open Database License.", "Licensed under the Microsoft Public License.",
    "This program is licensed under the terms of the vendor's own license.",
    "He works at MIT in Boston.", "A report by MIT came out in June.", "The MIT is a university.", "He teaches at MIT.",
    "The ISC and other groups took part.", "The members of the ISC are elected.", "At MIT and in Boston people work.",
]

# What says that a licence does not hold, or not yet.
DENIAL = (
    r"(?i)\b(?:not|never|no longer|isn.?t|aren.?t|wasn.?t|weren.?t)\W+(?:\w+\W+){0,3}"
    r"(?:licen[sc]ed|released|distributed|available|published|covered|under)\b"
    r"|\blicen[sc](?:e|ing)\W+(?:\w+\W+){0,2}(?:pending|undecided|unclear|unknown)\b|\bto be (?:determined|decided)\b"
    r"|\bno\W+(?:\w+\W+){0,2}licen[sc]e\b|\b(?:pending|proposed|instead of|previously|formerly|used to be)\W+(?:\w+\W+){0,4}licen[sc]"
)

# Words of which every notice of a family has one; a test holds all notices of the training against it. Words may be
# parted by line breaks and comment marks. Names that are common words elsewhere are in capitals or follow a phrase.
ANCHOR = (
    r"(?i)licen[sc]|copyright|permission|warrant(?:y|ies)\b|unencumbered|anyone[^a-z0-9]{1,9}is[^a-z0-9]{1,9}free|public[^a-z0-9]{1,9}domain|redistribut|\bapache\b|\bgnu\b|\b[al]?gpl|\bbsd\b"
    r"|\bmpl\b|mozilla|creative[^a-z0-9]{1,9}commons|\bcc[^a-z0-9]{1,9}by\b|\bcc0|unlicense|(?-i:\b(?:MIT|ISC|EXPAT)\b)"
    r"|\b(?:under|identifier)[^a-z0-9]{1,9}(?:(?:the|an?|terms|of)[^a-z0-9]{1,9}){0,4}(?:mit|isc|expat)\b"
)
