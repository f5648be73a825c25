"""Licence notices, headers and texts, as data: label, the wording, and phrases that must stand in their places.

Fixed values: public licence wordings.
"""

from __future__ import annotations

_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: "
)
_BSD_1 = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following "
    "disclaimer. "
)
_BSD_2 = (
    "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following "
    "disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_3 = (
    "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission. "
)
_BSD_4 = "All advertising materials mentioning features or use of this software must display the following acknowledgement"
_GNU = (
    "{it} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version"
)
_GNU_OLD = (
    "{it} is free software; you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation; either version {version} of the License, or (at your option) any later version"
)
_CC = "This work is licensed under a Creative Commons {name} {version} International License"
_CC_SHORT = "Licensed under CC {code} {version}"
_CC_NAMES = {
    "by": "Attribution",
    "by-sa": "Attribution-ShareAlike",
    "by-nd": "Attribution-NoDerivatives",
    "by-nc": "Attribution-NonCommercial",
    "by-nc-sa": "Attribution-NonCommercial-ShareAlike",
    "by-nc-nd": "Attribution-NonCommercial-NoDerivatives",
}
#: Identifiers that stand in source files after the SPDX tag, and the labels they give.
SPDX = {
    "MIT": "mit",
    "MIT-0": "mit-0",
    "Apache-2.0": "apache-2.0",
    "BSD-2-Clause": "bsd-2-clause",
    "BSD-3-Clause": "bsd-3-clause",
    "0BSD": "0bsd",
    "ISC": "isc",
    "Zlib": "zlib",
    "BSL-1.0": "bsl-1.0",
    "GPL-2.0-only": "gpl-2.0",
    "GPL-2.0-or-later": "gpl-2.0",
    "GPL-3.0-only": "gpl-3.0",
    "GPL-3.0-or-later": "gpl-3.0",
    "LGPL-2.1-only": "lgpl-2.1",
    "LGPL-2.1-or-later": "lgpl-2.1",
    "LGPL-3.0-only": "lgpl-3.0",
    "LGPL-3.0-or-later": "lgpl-3.0",
    "AGPL-3.0-only": "agpl-3.0",
    "AGPL-3.0-or-later": "agpl-3.0",
    "MPL-2.0": "mpl-2.0",
    "EPL-1.0": "epl-1.0",
    "EPL-2.0": "epl-2.0",
    "Artistic-2.0": "artistic-2.0",
    "OFL-1.1": "ofl-1.1",
    "ODbL-1.0": "odbl-1.0",
    "Unlicense": "unlicense",
    "CC0-1.0": "cc0-1.0",
}

TEMPLATES: list[tuple[str, str, list[str]]] = [
    ("agpl-3.0", _GNU.format(it="This program", name="Affero General Public License", version="3"), ["affero general public license", "either version 3"]),
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3", ["gnu affero general public license", "version 3"]),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", ["apache license", "version 2 0"]),
    (
        "apache-2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
        "distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND",
        ["apache org licenses license 2 0"],
    ),
    ("artistic-2.0", "under the terms of the Artistic License version 2.0", ["artistic license", "version 2 0"]),
    ("artistic-2.0", "This program is distributed under the terms of the Artistic License (2.0)", ["artistic license 2 0"]),
    ("bsd", _BSD, ["redistribution and use in source and binary forms"]),
    ("bsd-2-clause", _BSD + "1. " + _BSD_1 + "2. " + _BSD_2 + "THIS SOFTWARE IS PROVIDED", ["with the distribution this software is provided"]),
    ("bsd-3-clause", _BSD + "1. " + _BSD_1 + "2. " + _BSD_2 + "3. " + _BSD_3, ["neither the name of"]),
    ("bsd-3-clause", _BSD + _BSD_1 + _BSD_2 + _BSD_3, ["neither the name of"]),
    ("bsd-4-clause", _BSD + "1. " + _BSD_1 + "2. " + _BSD_2 + "3. " + _BSD_4, ["all advertising materials"]),
    (
        "bsl-1.0",
        "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and "
        "accompanying documentation covered by this license (the Software) to use, reproduce, display, distribute, execute, "
        "and transmit the Software",
        ["person or organization obtaining"],
    ),
    ("bsl-1.0", "Distributed under the Boost Software License, Version 1.0", ["boost software license", "version 1 0"]),
    ("cc0-1.0", "To the extent possible under law CC0 1.0 Universal public domain dedication", ["cc0 1 0"]),
    (
        "cc0-1.0",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        ["waived all copyright and related or neighboring rights"],
    ),
    ("epl-1.0", "made available under the terms of the Eclipse Public License v1.0", ["eclipse public license v1 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License 2.0", ["eclipse public license 2 0"]),
    ("epl-2.0", "made available under the terms of the Eclipse Public License v2.0", ["eclipse public license v2 0"]),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2", ["gnu general public license", "version 2"]),
    ("gpl-2.0", _GNU_OLD.format(it="This program", name="General Public License", version="2"), ["gnu general public license", "either version 2"]),
    ("gpl-2.0", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation", ["gnu general public license version 2"]),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3", ["gnu general public license", "version 3"]),
    ("gpl-3.0", _GNU.format(it="This program", name="General Public License", version="3"), ["gnu general public license", "either version 3"]),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies",
        ["with or without fee is hereby granted", "provided that the above copyright notice"],
    ),
    (
        "0bsd",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES",
        ["is hereby granted the software is provided"],
    ),
    ("lgpl-2.1", "This library is free software licensed under the GNU Lesser General Public License, version 2.1", ["gnu lesser general public license", "version 2 1"]),
    ("lgpl-2.1", _GNU_OLD.format(it="This library", name="Lesser General Public License", version="2.1"), ["gnu lesser general public license", "either version 2 1"]),
    ("lgpl-3.0", _GNU.format(it="This program", name="Lesser General Public License", version="3"), ["gnu lesser general public license", "either version 3"]),
    ("mit", "Released under the MIT License", ["mit license"]),
    ("mit", "Licensed under the MIT License", ["mit license"]),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        ["permission is hereby granted free of charge", "any person obtaining a copy of this software"],
    ),
    (
        "mit-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        "documentation files",
        ["permission is hereby granted free of charge", "any person obtaining a copy of this software"],
    ),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ["mozilla public license v 2 0"]),
    ("odbl-1.0", "This database is made available under the Open Database License", ["open database license"]),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1", ["sil open font license", "version 1 1"]),
    ("reserved", "Copyright. All rights reserved", ["all rights reserved"]),
    ("unlicense", "This is free and unencumbered software released into the public domain", ["free and unencumbered"]),
    (
        "wtfpl",
        "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it "
        "is allowed as long as the name is changed",
        ["as long as the name is changed"],
    ),
    (
        "zlib",
        "This software is provided as-is, without any express or implied warranty. In no event will the authors be held "
        "liable for any damages arising from the use of this software. Permission is granted to anyone to use this software "
        "for any purpose, including commercial applications, and to alter it and redistribute it freely",
        ["permission is granted to anyone", "redistribute it freely"],
    ),
]
for _code, _name in _CC_NAMES.items():
    _words = _name.lower().replace("-", " ")
    for _version in ("3.0", "4.0"):
        _said = _version.replace(".", " ")
        TEMPLATES.append((f"cc-{_code}-{_version}", _CC.format(name=_name, version=_version), [f"creative commons {_words} {_said}"]))
        TEMPLATES.append((f"cc-{_code}-{_version}", _CC_SHORT.format(code=_code.upper(), version=_version), [f"cc {_code.replace('-', ' ')} {_said}"]))
for _id, _label in SPDX.items():
    TEMPLATES.append((_label, f"SPDX-License-Identifier: {_id}", [f"spdx license identifier {_id.lower().replace('-', ' ').replace('.', ' ')}"]))
