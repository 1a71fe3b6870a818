"""Standard notices and key clauses of licence families, as the licences' own texts give them."""

from __future__ import annotations

_AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
_GNU = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {v} of the License, or (at your option) any later version."
_GNU_2 = "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
_GNU_3 = "You should have received a copy of the GNU {name} along with this program. If not, see <https://www.gnu.org/licenses/>."


def _gnu(name: str, short: str, versions: tuple[str, ...]) -> list[str]:
    out = [_GNU.format(name=name, v=v) for v in versions] + [_GNU_2.format(name=name), _GNU_3.format(name=name)]
    for v in versions:
        out += [f"This work is licensed under the GNU {name}, version {v}.", f"Licensed under the GNU {name}, version {v} or later.", f"Released under the terms of the GNU {name} v{v}.", f"SPDX-License-Identifier: {short}-{v}.0-or-later", f"SPDX-License-Identifier: {short}-{v}.0-only", f"Licensed under {short}v{v}."]
    return out


def _cc(name: str, short: str) -> list[str]:
    out = []
    for v in ("3.0", "4.0"):
        out += [f"This work is licensed under a Creative Commons {name} {v} International License.", f"Licensed under CC {short} {v}.", f"Licensed under the Creative Commons {name} {v} License.", f"SPDX-License-Identifier: CC-{short}-{v}", f"Text available under CC {short} {v}.", f"This article is distributed under the terms of the Creative Commons {name} License (CC {short} {v})."]
    return [*out, f"To view a copy of this license, visit https://creativecommons.org/licenses/{short.lower()}/4.0/ or send a letter to Creative Commons, PO Box 1866, Mountain View, CA 94042, USA."]


TEMPLATES: dict[str, list[str]] = {
    "MIT": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        _AS_IS + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the terms of the MIT license.", "Distributed under the MIT software license.", "SPDX-License-Identifier: MIT",
    ],
    "Apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0.", "Released under the Apache License 2.0.", "This project is licensed under the Apache 2.0 license.", "Distributed under the Apache Software License, version 2.0.", "SPDX-License-Identifier: Apache-2.0",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        "Licensed under the BSD 3-Clause License.", "Released under the BSD license.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-3-Clause", "SPDX-License-Identifier: BSD-2-Clause",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "Licensed under the ISC License.", "Released under the ISC license.", "SPDX-License-Identifier: ISC",
    ],
    "GPL": _gnu("General Public License", "GPL", ("2", "3")),
    "LGPL": _gnu("Lesser General Public License", "LGPL", ("2", "3")),
    "AGPL": _gnu("Affero General Public License", "AGPL", ("3",)),
    "MPL": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "Released under the Mozilla Public License 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
        "Licensed under the Eclipse Public License, version 2.0.", "SPDX-License-Identifier: EPL-2.0",
    ],
    "Unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
        "For more information, please refer to <https://unlicense.org>", "SPDX-License-Identifier: Unlicense", "Released into the public domain.", "This work is in the public domain.",
    ],
    "CC0": [
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Licensed under CC0 1.0 Universal.", "This work is dedicated to the public domain under CC0 1.0.", "SPDX-License-Identifier: CC0-1.0",
    ],
    "CC-BY": _cc("Attribution", "BY"),
    "CC-BY-SA": _cc("Attribution-ShareAlike", "BY-SA"),
    "CC-BY-NC": _cc("Attribution-NonCommercial", "BY-NC"),
    "CC-BY-ND": _cc("Attribution-NoDerivatives", "BY-ND"),
    "CC-BY-NC-SA": _cc("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "CC-BY-NC-ND": _cc("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "Proprietary": [
        "All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited. Proprietary and confidential.", "This material may not be published, broadcast, rewritten, or redistributed without permission.",
    ],
}

#: Paragraphs that speak of licences or of the law and are no grant: examples of the unknown class.
OTHER = [
    "She renewed her driving license at the office in town before the holidays.", "The bank lost its license after the audit.", "A licensed electrician must inspect the wiring.",
    "The company released the new version under pressure from its customers.", "The general public was not admitted to the hearing.", "The apache helicopter landed at dawn.", "Students at MIT built a small robot.",
    "The commons were used by all villagers to graze their sheep.", "Creative people work in many fields.", "Human rights are reserved for every person, the speaker said.", "All seats are reserved.",
    "This work is hard and never done.", "Version 3.0 of the program is available now.", "Read the terms and conditions before you sign the contract.", "The software is provided to schools in the county free of charge.",
    "The publisher announced a new edition of the dictionary.", "The court granted permission to appeal.", "Redistribution of wealth was the topic of the debate.", "Use of the pool is permitted until nine in the evening.",
    "The warranty covers parts and labour for two years.", "The foundation supports free concerts in the park.", "The author thanks her family and friends.", "No part of the house had been painted.", "The work is in the museum of modern art.",
    "Fishing without a license is forbidden in this county.", "The restaurant applied for a liquor license last spring.", "He was fined for driving without a valid licence.",
    "The peace agreement was released under the terms of the treaty.", "Released under the terms of the agreement between the two towns.", "The court ordered that the notice be given to any person named in the case.",
    "The doctor lost his licence to practise medicine.", "Software is sold in the shop next to the station.", "Copies of the report are available at the library.", "The license plate was found near the bridge.",
    "A license fee must be paid for every television.", "The general conditions of the contract were changed.", "The eclipse was seen by the public on both coasts.", "Mozilla is the name of a small cat in the story.",
]

#: Lines of one or two words, or a name alone, that stand over or for a licence. A line must be equal to one of them.
HEADINGS: dict[str, list[str]] = {
    "MIT": ["MIT", "MIT License", "The MIT License", "License: MIT", "The MIT License (MIT)", "MIT Licence"],
    "Apache": ["Apache License", "Apache 2.0", "License: Apache 2.0", "Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0"],
    "BSD": ["BSD License", "License: BSD", "BSD 3-Clause License", "BSD 2-Clause License", "BSD-3-Clause", "BSD-2-Clause"],
    "ISC": ["ISC License", "License: ISC", "The ISC License"],
    "GPL": ["GNU General Public License", "GNU GPL", "GPLv3", "GPLv2", "GPL v3", "GPL v2", "License: GPL", "License: GPLv3"],
    "LGPL": ["GNU Lesser General Public License", "GNU LGPL", "LGPLv3", "License: LGPL"],
    "AGPL": ["GNU Affero General Public License", "GNU AGPL", "AGPLv3", "License: AGPL"],
    "MPL": ["Mozilla Public License", "Mozilla Public License 2.0", "MPL 2.0", "License: MPL"],
    "EPL": ["Eclipse Public License", "Eclipse Public License 2.0", "EPL 2.0", "License: EPL"],
    "Unlicense": ["The Unlicense", "License: Unlicense", "Public domain"],
    "CC0": ["CC0", "CC0 1.0", "CC0 1.0 Universal", "License: CC0"],
    "CC-BY": ["CC BY", "CC BY 4.0", "CC BY 3.0", "Creative Commons Attribution"],
    "CC-BY-SA": ["CC BY-SA", "CC BY-SA 4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike"],
    "CC-BY-NC": ["CC BY-NC", "CC BY-NC 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial"],
    "CC-BY-ND": ["CC BY-ND", "CC BY-ND 4.0", "CC BY-ND 3.0", "Creative Commons Attribution-NoDerivatives"],
    "CC-BY-NC-SA": ["CC BY-NC-SA", "CC BY-NC-SA 4.0", "CC BY-NC-SA 3.0", "Creative Commons Attribution-NonCommercial-ShareAlike"],
    "CC-BY-NC-ND": ["CC BY-NC-ND", "CC BY-NC-ND 4.0", "CC BY-NC-ND 3.0", "Creative Commons Attribution-NonCommercial-NoDerivatives"],
    "Proprietary": ["All rights reserved", "Proprietary", "Confidential and proprietary"],
}

#: Words that take back what follows them.
NEGATIONS = ("not", "no", "never", "neither", "nor", "cannot", "isn", "aren", "wasn", "without")
