"""License wordings in template markup: (label, template).

Fixed texts of public licenses and of the notices that name them.  Outside the marks every word is
mandatory; case and everything but letters and digits between words is ignored.

``<<beginOptional>> ... <<endOptional>>``   may be left out (marks may be nested)
``<<var;words=LO..HI>>``                    LO to HI words of any kind stand here
"""

# The phrases that name a license, and the label each stands for (fixed values).
PHRASES = [
    ("gpl", "gnu general public license"),
    ("apache", "apache license"),
    ("cc-by", "cc by"),
    ("mit", "mit license"),
]

# Notices and license texts (fixed values).
TEMPLATES = [
    ("apache-2.0", """<<beginOptional>>This <<var;words=1..3>> is<<endOptional>> Licensed under the Apache License,
        Version 2.0"""),
    ("apache-2.0", """<<beginOptional>>Released<<endOptional>> <<beginOptional>>Distributed<<endOptional>> under the
        <<beginOptional>>terms of the<<endOptional>> Apache License, Version 2.0"""),
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this
        <<var;words=1..3>> except in compliance with the License. You may obtain a copy of the License at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> www.apache.org/licenses/LICENSE-2.0
        Unless required by applicable law or agreed to in writing, software distributed under the License is
        distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
        See the License for the specific language governing permissions and limitations under the License."""),
    ("gpl-2.0", """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License,
        <<beginOptional>>version<<endOptional>> <<beginOptional>>v<<endOptional>> 2"""),
    ("gpl-3.0", """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU General Public License,
        <<beginOptional>>version<<endOptional>> 3"""),
    ("gpl-3.0-or-later", """<<beginOptional>>This program<<endOptional>> is free software: you can
        redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free
        Software Foundation, either version 3 of the License, or (at your option) any later version."""),
    ("gpl-2.0-or-later", """This program is free software; you can redistribute it and/or modify it under the
        terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the
        License, or (at your option) any later version."""),
    ("lgpl", """licensed under the <<beginOptional>>terms of the<<endOptional>> GNU Lesser General Public License"""),
    ("mit-notice", """<<beginOptional>>Released<<endOptional>> <<beginOptional>>Licensed<<endOptional>>
        <<beginOptional>>Distributed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> MIT License"""),
    ("mit-text", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
        associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
        following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next
        paragraph)<<endOptional>> shall be included in all copies or substantial portions of the Software.
        THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED
        TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL
        <<var;words=1..20>> BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
        TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
        THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any
        purpose with or without fee is hereby granted, provided that the above copyright notice and this permission
        notice appear in all copies.
        THE SOFTWARE IS PROVIDED "AS IS" AND <<var;words=1..20>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE
        INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;words=1..20>> BE
        LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM
        LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING
        OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("bsd-2-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        <<var;words=0..1>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.
        <<var;words=0..1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        <<beginOptional>>THIS SOFTWARE IS PROVIDED BY <<var;words=1..20>> "AS IS" AND ANY EXPRESS OR IMPLIED
        WARRANTIES<<endOptional>>"""),
    ("bsd-3-clause", """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met:
        <<var;words=0..1>> Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.
        <<var;words=0..1>> Redistributions in binary form must reproduce the above copyright notice, this list of
        conditions and the following disclaimer in the documentation and/or other materials provided with the
        distribution.
        <<var;words=0..1>> Neither the name of <<var;words=1..20>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission."""),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at
        <<beginOptional>>http<<endOptional>> <<beginOptional>>https<<endOptional>> mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy,
        modify, publish, use, compile, sell, or distribute this software"""),
    ("cc-by-4.0", """licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>>
        Creative Commons Attribution 4.0 International <<beginOptional>>Public<<endOptional>> License"""),
    ("cc-by-4.0", """<<beginOptional>>licensed<<endOptional>> <<beginOptional>>released<<endOptional>> under
        <<beginOptional>>the<<endOptional>> CC BY 4.0"""),
    ("cc-by-sa-4.0", """<<beginOptional>>licensed<<endOptional>> <<beginOptional>>released<<endOptional>> under
        <<beginOptional>>the<<endOptional>> CC BY-SA 4.0"""),
    ("cc-by-nc-4.0", """<<beginOptional>>licensed<<endOptional>> <<beginOptional>>released<<endOptional>> under
        <<beginOptional>>the<<endOptional>> CC BY-NC 4.0"""),
    ("cc0-1.0", """<<beginOptional>>released<<endOptional>> under <<beginOptional>>the<<endOptional>> CC0 1.0"""),
]
