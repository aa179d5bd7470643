"""The wording of public licenses and notices, with optional and replaceable regions."""

from __future__ import annotations

_HOLDER = "<<optional>> Copyright <<var 0-30>> <<end>>"

MIT = f"""<<optional>> The <<end>> <<optional>> MIT License <<optional>> MIT <<end>> <<end>> {_HOLDER}
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to
permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice <<optional>> (including the next
paragraph) <<end>> shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL <<var 1-8>> BE LIABLE FOR ANY CLAIM, DAMAGES OR
OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""

_BSD_HEAD = f"""<<optional>> BSD <<var 1-1>> Clause License <<end>> {_HOLDER}
Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
<<optional>> 1 <<end>> Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
<<optional>> 2 <<end>> Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials
provided with the distribution."""
_BSD_THIRD = """<<optional>> 3 <<end>> Neither the name of <<var 1-12>> nor the names of <<optional>> its <<end>> <<optional>> any <<end>> contributors may be used to endorse or promote products derived from this software
without specific prior written permission."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY <<var 1-10>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A
PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL <<var 1-10>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT
(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD_2 = f"{_BSD_HEAD} {_BSD_TAIL}"
BSD_3 = f"{_BSD_HEAD} {_BSD_THIRD} {_BSD_TAIL}"

_GRANT = f"""<<optional>> <<optional>> The <<end>> ISC License <<end>> <<optional>> BSD Zero Clause License <<end>> {_HOLDER}
Permission to use, copy, modify, and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted"""
_AS_IS = """THE SOFTWARE IS PROVIDED "AS IS" AND <<var 1-5>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL
<<var 1-5>> BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR
OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
ISC = f"{_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_AS_IS}"
ZERO_BSD = f"{_GRANT}. {_AS_IS}"

APACHE_NOTICE = f"""{_HOLDER} Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
<<optional>> http www apache org licenses LICENSE 2 0 <<end>> <<optional>> https www apache org licenses LICENSE 2 0 <<end>> Unless required by applicable law or agreed to in writing, software distributed under the License is
distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under
the License."""

UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or
as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright
interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt
act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT
NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. <<optional>> For more information, please refer to <<var 1-6>> <<end>>"""

ZLIB = f"""<<optional>> <<optional>> The <<end>> zlib License <<end>> {_HOLDER} This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from
the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
restrictions: <<optional>> 1 <<end>> The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. <<optional>> 2 <<end>> Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
<<optional>> 3 <<end>> This notice may not be removed or altered from any source distribution."""


def gnu_notice(name: str) -> str:
    """The notice of a GNU license in a file's head; ``name`` is "Lesser", "Affero" or empty."""
    return f"""{_HOLDER} <<var 1-6>> is free software: you can redistribute it and/or modify it under the terms of the GNU {name} General Public License as published by the Free Software Foundation,
either version <<var 1-2>> of the License, or (at your option) any later version. <<var 1-6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied
warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} General Public License for more details. <<optional>> You should have received a copy of the GNU {name} General Public
License along with <<var 1-6>> If not, see <<var 1-6>> <<end>>"""
