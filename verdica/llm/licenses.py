"""Wording by which licences are known: notices, and the texts of the short ones."""

_AS_IS = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, "
    "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
_BSD_TWO = (
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_FOURTH = "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by the organization. 4. Neither the name of the organization nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"


def _gnu(what: str, title: str, version: str, short: str) -> tuple[str, ...]:
    return (
        f"This work is licensed under the {title}, version {version}.",
        f"Licensed under the {short}, version {version}.",
        f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.",
        f"This {what} is free software; you can redistribute it and/or modify it under the terms of the {title} as published by the Free Software Foundation, version {version} of the License.",
    )


def _commons() -> dict[str, tuple[str, ...]]:
    parts = {"BY": "Attribution", "BY-SA": "Attribution-ShareAlike", "BY-NC": "Attribution-NonCommercial", "BY-ND": "Attribution-NoDerivatives", "BY-NC-SA": "Attribution-NonCommercial-ShareAlike", "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives"}
    return {
        f"CC-{code}-{version}": (f"Licensed under CC {code} {version}.", f"This work is licensed under a Creative Commons {words} {version} {port} License.")
        for code, words in parts.items() for version, port in (("4.0", "International"), ("3.0", "Unported"))
    }


TEMPLATES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION",
    ),
    "Apache-1.1": ("Licensed under the Apache License, Version 1.1.", "The Apache Software License, Version 1.1"),
    "MIT": ("Released under the MIT License.", "Licensed under the MIT License.", f"MIT License. {_MIT}", f"{_MIT}, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. {_AS_IS}"),
    "MIT-0": ("Released under the MIT No Attribution License.", f"{_MIT}. {_AS_IS}"),
    "ISC": ("Released under the ISC License.", f"{_ISC}, provided that the above copyright notice and this permission notice appear in all copies."),
    "0BSD": ("Released under the Zero-Clause BSD License.", f"{_ISC}. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    "BSD-2-Clause": ("Licensed under the BSD 2-Clause License.", _BSD + _BSD_TWO + _BSD_END),
    "BSD-3-Clause": ("Licensed under the BSD 3-Clause License.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", _BSD + _BSD_TWO + _BSD_THIRD + _BSD_END),
    "BSD-4-Clause": ("Licensed under the BSD 4-Clause License.", _BSD + _BSD_TWO + _BSD_FOURTH + _BSD_END),
    "GPL-2.0": _gnu("program", "GNU General Public License", "2", "GNU GPL"),
    "GPL-3.0": _gnu("program", "GNU General Public License", "3", "GNU GPL"),
    "LGPL-2.1": _gnu("library", "GNU Lesser General Public License", "2.1", "GNU LGPL"),
    "LGPL-3.0": _gnu("library", "GNU Lesser General Public License", "3", "GNU LGPL"),
    "AGPL-3.0": _gnu("program", "GNU Affero General Public License", "3", "GNU AGPL"),
    "MPL-1.1": ("The contents of this file are subject to the Mozilla Public License Version 1.1", "Licensed under the Mozilla Public License, version 1.1."),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."),
    "EPL-1.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0",),
    "EPL-2.0": ("This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",),
    "BSL-1.0": ("Distributed under the Boost Software License, Version 1.0.",),
    "Zlib": ("Released under the zlib License.", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely"),
    "Unlicense": ("Released under the Unlicense.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    "CC0-1.0": ("Licensed under CC0 1.0.", "This work is dedicated to the public domain under the Creative Commons CC0 1.0 Universal Public Domain Dedication.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal."),
    **_commons(),
}
