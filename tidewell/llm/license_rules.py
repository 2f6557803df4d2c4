"""Signature rules of licences, written by hand: label | kind | regular expression, most important first.

Expressions are matched against a text's words in lower case with one space between (so `GPL-2.0` is
`gpl 2 0`), and begin and end at words. Abbreviations: <L> license, <V> a version's introduction,
<U> words of a grant. Kinds: tag (a machine-readable identifier), text (a passage of the licence itself), notice
(a grant), url, title (its name), mention (a short name), base (the four phrases that are always
counted), none (what looks like a licence and is not; it has no label and takes what it contains away).
"""

from __future__ import annotations

ABBREVIATIONS = {
    "<L>": "licen[cs]e",
    "<V>": "(?:version |v |ver |rev )?",
    "<U>": "(?:licensed |released |distributed |available |provided |published |covered |redistributed |shared |offered )(?:to you )?under (?:the )?(?:terms of )?(?:the )?",
}

TABLE = r"""
none | none | not (?:licensed |released |distributed )under (?:the )?(?:terms of )?(?:the )?(?:gnu |apache |mit |bsd |mozilla )\w+
none | none | (?:incompatible|not compatible) with (?:the )?(?:gnu )?(?:a|l)?gpl
none | none | (?:driver|drivers|driving|fishing|hunting|marriage|pilot|liquor|business|dog) license(?: (?:plate|number|office))?
none | none | license plates?
none | none | apache (?:helicopters?|tribes?|nation|http server|junction)
none | none | mit (?:press|media lab|opencourseware|students?|campus)
none | none | bsd (?:sockets?|make|unix|games)
none | none | copyright (?:act|law|laws|office|infringement|protection)
gpl-1.0 | tag | spdx <L> identifier gpl 1 0(?: only)?
gpl-1.0-or-later | tag | spdx <L> identifier gpl 1 0 or later
gpl-2.0 | tag | spdx <L> identifier gpl 2 0(?: only)?
gpl-2.0-or-later | tag | spdx <L> identifier gpl 2 0 or later
gpl-3.0 | tag | spdx <L> identifier gpl 3 0(?: only)?
gpl-3.0-or-later | tag | spdx <L> identifier gpl 3 0 or later
lgpl-2.0 | tag | spdx <L> identifier lgpl 2 0(?: only)?
lgpl-2.1 | tag | spdx <L> identifier lgpl 2 1(?: only)?
lgpl-2.1-or-later | tag | spdx <L> identifier lgpl 2 1 or later
lgpl-3.0 | tag | spdx <L> identifier lgpl 3 0(?: only)?
lgpl-3.0-or-later | tag | spdx <L> identifier lgpl 3 0 or later
agpl-3.0 | tag | spdx <L> identifier agpl 3 0(?: only)?
agpl-3.0-or-later | tag | spdx <L> identifier agpl 3 0 or later
apache-2.0 | tag | spdx <L> identifier apache 2 0
mit | tag | spdx <L> identifier mit
mit-0 | tag | spdx <L> identifier mit 0
bsd-2-clause | tag | spdx <L> identifier bsd 2 clause
bsd-3-clause | tag | spdx <L> identifier bsd 3 clause
bsd-4-clause | tag | spdx <L> identifier bsd 4 clause
0bsd | tag | spdx <L> identifier 0bsd
isc | tag | spdx <L> identifier isc
mpl-1.1 | tag | spdx <L> identifier mpl 1 1
mpl-2.0 | tag | spdx <L> identifier mpl 2 0
epl-1.0 | tag | spdx <L> identifier epl 1 0
epl-2.0 | tag | spdx <L> identifier epl 2 0
cddl-1.0 | tag | spdx <L> identifier cddl 1 0
cddl-1.1 | tag | spdx <L> identifier cddl 1 1
bsl-1.0 | tag | spdx <L> identifier bsl 1 0
unlicense | tag | spdx <L> identifier unlicense
cc0-1.0 | tag | spdx <L> identifier cc0 1 0
cc-by-4.0 | tag | spdx <L> identifier cc by 4 0
cc-by-sa-4.0 | tag | spdx <L> identifier cc by sa 4 0
cc-by-nc-4.0 | tag | spdx <L> identifier cc by nc 4 0
cc-by-nd-4.0 | tag | spdx <L> identifier cc by nd 4 0
wtfpl | tag | spdx <L> identifier wtfpl
zlib | tag | spdx <L> identifier zlib
artistic-2.0 | tag | spdx <L> identifier artistic 2 0
eupl-1.2 | tag | spdx <L> identifier eupl 1 2
ofl-1.1 | tag | spdx <L> identifier ofl 1 1
psf-2.0 | tag | spdx <L> identifier psf 2 0
ms-pl | tag | spdx <L> identifier ms pl
odbl-1.0 | tag | spdx <L> identifier odbl 1 0
gpl-3.0 | text | gnu general public license version 3 29 june 2007
gpl-2.0 | text | gnu general public license version 2 june 1991
gpl-1.0 | text | gnu general public license version 1 february 1989
lgpl-3.0 | text | gnu lesser general public license version 3 29 june 2007
lgpl-2.1 | text | gnu lesser general public license version 2 1 february 1999
lgpl-2.0 | text | gnu library general public license version 2 june 1991
agpl-3.0 | text | gnu affero general public license version 3 19 november 2007
gfdl-1.3 | text | gnu free documentation license version 1 3 3 november 2008
gfdl-1.2 | text | gnu free documentation license version 1 2 november 2002
gpl | text | this program is free software you can redistribute it and or modify it under the terms of the gnu general public <L>
gpl-2.0 | text | under the terms of the gnu general public <L> as published by the free software foundation either version 2
gpl-2.0-or-later | text | gnu general public <L> as published by the free software foundation either version 2 of the <L> or at your option any later version
gpl-3.0-or-later | text | gnu general public <L> as published by the free software foundation either version 3 of the <L> or at your option any later version
gpl | text | you should have received a copy of the gnu general public <L>
lgpl | text | you should have received a copy of the gnu (?:lesser|library) general public <L>
agpl | text | you should have received a copy of the gnu affero general public <L>
gpl | text | either version \d of the <L> or at your option any later version
gpl | text | the licenses for most software are designed to take away your freedom to share and change it
gpl-3.0 | text | the gnu general public license is a free copyleft license for software and other kinds of works
agpl-3.0 | text | specifically designed to ensure cooperation with the community in the case of network server software
lgpl-2.1-or-later | text | gnu lesser general public <L> as published by the free software foundation either version 2 1 of the <L> or at your option any later version
lgpl-3.0-or-later | text | gnu lesser general public <L> as published by the free software foundation either version 3 of the <L> or at your option any later version
agpl-3.0-or-later | text | gnu affero general public <L> as published by the free software foundation either version 3 of the <L> or at your option any later version
gfdl | text | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation <L>
apache-2.0 | text | apache license version 2 0 january 2004
apache-2.0 | text | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
apache-2.0 | text | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0 | text | you may not use this file except in compliance with the license
apache-2.0 | text | you may obtain a copy of the license at http www apache org licenses license 2 0
apache-1.1 | text | the apache software license version 1 1
apache-1.1 | text | this product includes software developed by the apache software foundation
mit | text | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
mit | text | the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit | text | the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability
mit | text | in no event shall the authors or copyright holders be liable for any claim damages or other liability
x11 | text | except as contained in this notice the name of the x consortium shall not be used in advertising
mit-0 | text | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,200}sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided
bsd | text | redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met
bsd | text | redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer
bsd | text | redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer
bsd-3-clause | text | neither the name of .{1,120}? nor the names of (?:its|any|other) contributors may be used to endorse or promote products
bsd-4-clause | text | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
bsd | text | this software is provided by the copyright holders and contributors as is and any express or implied warranties
bsd-uc | text | this software is provided by the regents and contributors as is
isc | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
isc | text | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice
0bsd | text | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
mpl-2.0 | text | this source code form is subject to the terms of the mozilla public license v 2 0
mpl-2.0 | text | if a copy of the mpl was not distributed with this file you can obtain one at
mpl-1.1 | text | the contents of this file are subject to the mozilla public license version 1 1
mpl-1.0 | text | the contents of this file are subject to the mozilla public license version 1 0
npl-1.1 | text | the contents of this file are subject to the netscape public license version 1 1
epl-1.0 | text | this program and the accompanying materials are made available under the terms of the eclipse public license v1 0
epl-2.0 | text | this program and the accompanying materials are made available under the terms of the eclipse public license (?:v )?2 0
cpl-1.0 | text | the accompanying program is provided under the terms of this common public license
cddl | text | the contents of this file are subject to the terms of the common development and distribution license
cddl-1.1 | text | you may only use this file in compliance with the license you can obtain a copy of the license at https? (?:glassfish|oss)
bsl-1.0 | text | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
bsl-1.0 | text | boost software license version 1 0 august 17th 2003
zlib | text | this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software
zlib | text | the origin of this software must not be misrepresented you must not claim that you wrote the original software
unlicense | text | this is free and unencumbered software released into the public domain
unlicense | text | anyone is free to copy modify publish use compile sell or distribute this software
wtfpl | text | do what the fuck you want to public license
wtfpl | text | you just do what the fuck you want to
cc0-1.0 | text | to the extent possible under law .{1,120}? (?:has|have) waived all copyright and related or neighboring rights
cc0-1.0 | text | creative commons legal code cc0 1 0 universal
cc-by | text | you must give appropriate credit provide a link to the license and indicate if changes were made
cc-by-sa | text | if you remix transform or build upon the material you must distribute your contributions under the same license
cc-by-nc | text | you may not use the material for commercial purposes
cc-by-nd | text | if you remix transform or build upon the material you may not distribute the modified material
artistic-1.0 | text | the intent of this document is to state the conditions under which a package may be copied
artistic-2.0 | text | everyone is permitted to copy and distribute verbatim copies of this license document .{0,80}artistic license 2 0
eupl-1.2 | text | licensed under the eupl version 1 2
eupl-1.1 | text | licensed under the eupl version 1 1
eupl | text | you may not use this work except in compliance with the licen[cs]e .{0,120}joinup ec europa eu
ofl-1.1 | text | sil open font license version 1 1 26 february 2007
ofl-1.1 | text | this font software is licensed under the sil open font license version 1 1
psf-2.0 | text | python software foundation license version 2
python | text | this license agreement is between the python software foundation
ruby | text | you may redistribute it and or modify it under either the terms of the 2 clause bsdl
php-3.01 | text | this source file is subject to version 3 01 of the php license
php-3.0 | text | this source file is subject to version 3 0 of the php license
openssl | text | this product includes software developed by the openssl project for use in the openssl toolkit
ssleay | text | this product includes cryptographic software written by eric young
curl | text | permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted .{0,200}curl
icu | text | icu license icu 1 8 1 and later
unicode | text | unicode inc license agreement data files and software
libpng | text | this copy of the libpng notices is provided for your convenience
ijg | text | this software is based in part on the work of the independent jpeg group
ftl | text | portions of this software are copyright .{0,40}the freetype project
postgresql | text | in no event shall the university of california be liable to any party for direct indirect special incidental or consequential damages
ncsa | text | permission is hereby granted free of charge to any person obtaining a copy of this software .{0,80}to deal with the software without restriction
w3c | text | by obtaining and or copying this work you the licensee agree that you have read understood and will comply with the following terms
vim | text | there are no restrictions on distributing unmodified copies of vim
beerware | text | as long as you retain this notice you can do whatever you want with this stuff
json | text | the software shall be used for good not evil
public-domain | text | (?:this|the) (?:software|work|file|code|document|text) is (?:hereby )?(?:in|placed in|placed into|released into|dedicated to) the public domain
sspl-1.0 | text | server side public license version 1 october 16 2018
busl-1.1 | text | business source license 1 1
elastic-2.0 | text | elastic license 2 0
commons-clause | text | the software is provided to you by the licensor under the license as defined below subject to the following condition
polyform | text | polyform (?:noncommercial|shield|strict|internal use|small business|free trial) license 1 0 0
openrail | text | (?:creativeml )?open rail ?[ms]? license
llama | text | llama \d (?:\d )?community license agreement
odbl-1.0 | text | open database license odbl v1 0
proprietary | text | unauthorized copying of this file via any medium is strictly prohibited
proprietary | text | this (?:software|document|file|material) (?:is|contains) (?:the )?(?:confidential and proprietary|proprietary and confidential)
all-rights-reserved | text | no part of this (?:publication|book|work|document) may be reproduced
gpl-3.0 | notice | <U>gnu general public <L> <V>3(?: 0)?
gpl-2.0 | notice | <U>gnu general public <L> <V>2(?: 0)?
gpl-3.0-or-later | notice | <U>gnu general public <L> <V>3(?: 0)? or (?:any )?(?:later|newer|above)
gpl-2.0-or-later | notice | <U>gnu general public <L> <V>2(?: 0)? or (?:any )?(?:later|newer|above)
gpl | notice | <U>gnu general public <L>
gpl | notice | <U>gnu gpl
gpl | notice | <U>gpl
gpl-2.0 | notice | <U>(?:gnu )?gpl <V>2(?: 0)?
gpl-3.0 | notice | <U>(?:gnu )?gpl <V>3(?: 0)?
lgpl-2.1 | notice | <U>gnu lesser general public <L> <V>2 1
lgpl-3.0 | notice | <U>gnu lesser general public <L> <V>3(?: 0)?
lgpl | notice | <U>gnu (?:lesser|library) general public <L>
lgpl | notice | <U>lgpl
agpl-3.0 | notice | <U>gnu affero general public <L> <V>3(?: 0)?
agpl | notice | <U>gnu affero general public <L>
agpl | notice | <U>agpl
gfdl | notice | <U>gnu free documentation <L>
apache-2.0 | notice | <U>apache <L> <V>2(?: 0)?
apache-1.1 | notice | <U>apache <L> <V>1 1
apache-2.0 | notice | <U>apache 2(?: 0)? <L>
apache | notice | <U>apache <L>
mit | notice | <U>mit <L>
mit | notice | <U>mit x11 <L>
mit | notice | <U>expat <L>
bsd-2-clause | notice | <U>(?:simplified |2 clause |two clause )bsd <L>
bsd-3-clause | notice | <U>(?:new |modified |revised |3 clause |three clause )bsd <L>
bsd-4-clause | notice | <U>(?:original |4 clause |four clause )bsd <L>
bsd | notice | <U>bsd(?: style)? <L>
isc | notice | <U>isc <L>
mpl-2.0 | notice | <U>mozilla public <L> <V>2(?: 0)?
mpl-1.1 | notice | <U>mozilla public <L> <V>1 1
mpl | notice | <U>mozilla public <L>
epl-1.0 | notice | <U>eclipse public <L> <V>1 0
epl-2.0 | notice | <U>eclipse public <L> <V>2 0
epl | notice | <U>eclipse public <L>
cddl | notice | <U>common development and distribution <L>
bsl-1.0 | notice | <U>boost software <L>
artistic-2.0 | notice | <U>artistic <L> <V>2(?: 0)?
artistic | notice | <U>artistic <L>
zlib | notice | <U>zlib(?: libpng)? <L>
unlicense | notice | <U>unlicense
psf-2.0 | notice | <U>python software foundation <L>
perl | notice | <U>same terms as perl itself
cc0-1.0 | notice | <U>(?:cc0|creative commons zero)(?: 1 0)?
cc-by-4.0 | notice | <U>(?:cc by|creative commons attribution) 4 0
cc-by-3.0 | notice | <U>(?:cc by|creative commons attribution) 3 0
cc-by-sa-4.0 | notice | <U>(?:cc by sa|creative commons attribution share ?alike) 4 0
cc-by-sa-3.0 | notice | <U>(?:cc by sa|creative commons attribution share ?alike) 3 0
cc-by-nc-4.0 | notice | <U>(?:cc by nc|creative commons attribution non ?commercial) 4 0
cc-by-nc-3.0 | notice | <U>(?:cc by nc|creative commons attribution non ?commercial) 3 0
cc-by-nd-4.0 | notice | <U>(?:cc by nd|creative commons attribution no ?deriv(?:ative)?s) 4 0
cc-by-nc-sa-4.0 | notice | <U>(?:cc by nc sa|creative commons attribution non ?commercial share ?alike) 4 0
cc-by-nc-nd-4.0 | notice | <U>(?:cc by nc nd|creative commons attribution non ?commercial no ?deriv(?:ative)?s) 4 0
cc-by-sa | notice | <U>(?:cc by sa|creative commons attribution share ?alike)
cc-by-nc | notice | <U>(?:cc by nc|creative commons attribution non ?commercial)
cc-by | notice | <U>(?:cc by|creative commons attribution)
creative-commons | notice | <U>creative commons <L>
odbl-1.0 | notice | <U>open database <L>
public-domain | notice | (?:released|dedicated) (?:in)?to the public domain
gpl-3.0 | url | www gnu org licenses gpl 3 0
gpl-2.0 | url | www gnu org licenses (?:old licenses )?gpl 2 0
lgpl-2.1 | url | www gnu org licenses (?:old licenses )?lgpl 2 1
lgpl-3.0 | url | www gnu org licenses lgpl 3 0
agpl-3.0 | url | www gnu org licenses agpl 3 0
gfdl | url | www gnu org (?:licenses|copyleft) fdl
gpl | url | www gnu org (?:licenses|copyleft) gpl
apache-2.0 | url | www apache org licenses license 2 0
mit | url | opensource org licenses mit(?: license)?
bsd-3-clause | url | opensource org licenses bsd 3 clause
bsd-2-clause | url | opensource org licenses bsd 2 clause
isc | url | opensource org licenses isc
mpl-2.0 | url | (?:www )?mozilla org mpl 2 0
mpl-1.1 | url | www mozilla org mpl mpl 1 1
epl-1.0 | url | www eclipse org legal epl v10
epl-2.0 | url | www eclipse org legal epl (?:v20|2 0)
bsl-1.0 | url | www boost org license 1 0
unlicense | url | unlicense org
cc0-1.0 | url | creativecommons org publicdomain zero 1 0
public-domain | url | creativecommons org publicdomain mark 1 0
cc-by-4.0 | url | creativecommons org licenses by 4 0
cc-by-3.0 | url | creativecommons org licenses by 3 0
cc-by-sa-4.0 | url | creativecommons org licenses by sa 4 0
cc-by-sa-3.0 | url | creativecommons org licenses by sa 3 0
cc-by-nc-4.0 | url | creativecommons org licenses by nc 4 0
cc-by-nd-4.0 | url | creativecommons org licenses by nd 4 0
cc-by-nc-sa-4.0 | url | creativecommons org licenses by nc sa 4 0
cc-by-nc-nd-4.0 | url | creativecommons org licenses by nc nd 4 0
creative-commons | url | creativecommons org licenses \w+
ofl-1.1 | url | scripts sil org ofl
eupl | url | joinup ec europa eu software page eupl
odbl-1.0 | url | opendatacommons org licenses odbl
php-3.01 | url | www php net license 3 01
gpl-3.0 | title | gnu general public <L> <V>3(?: 0)?
gpl-2.0 | title | gnu general public <L> <V>2(?: 0)?
gpl | base | gnu general public license
gpl | title | (?:gnu )?general public licen[cs]e
lgpl-2.1 | title | gnu lesser general public <L> <V>2 1
lgpl-3.0 | title | gnu lesser general public <L> <V>3(?: 0)?
lgpl | title | gnu (?:lesser|library) general public <L>
agpl-3.0 | title | gnu affero general public <L> <V>3(?: 0)?
agpl | title | (?:gnu )?affero general public <L>
gfdl | title | gnu free documentation <L>
apache-2.0 | title | apache <L> <V>2(?: 0)?
apache | base | apache license
apache | title | apache (?:software )?<L>
mit | base | mit license
mit | title | (?:the )?mit <L>
bsd-2-clause | title | (?:simplified |freebsd |2 clause |two clause )bsd <L>
bsd-2-clause | title | bsd 2 clause(?: <L>)?
bsd-3-clause | title | (?:new |modified |revised |3 clause |three clause )bsd <L>
bsd-3-clause | title | bsd 3 clause(?: <L>)?
bsd-4-clause | title | (?:original |4 clause |four clause )bsd <L>
bsd | title | bsd(?: style)? <L>
isc | title | isc <L>
mpl-2.0 | title | mozilla public <L> <V>2(?: 0)?
mpl-1.1 | title | mozilla public <L> <V>1 1
mpl | title | mozilla public <L>
epl | title | eclipse public <L>
cpl-1.0 | title | common public <L>
cddl | title | common development and distribution <L>
bsl-1.0 | title | boost software <L>
zlib | title | zlib(?: libpng)? <L>
artistic-2.0 | title | artistic <L> <V>2(?: 0)?
artistic | title | artistic <L>
eupl | title | european union public licen[cs]e
ofl-1.1 | title | sil open font <L>
psf-2.0 | title | python software foundation <L>
php | title | php <L>
openssl | title | openssl <L>
ncsa | title | university of illinois ncsa open source <L>
ms-pl | title | microsoft public <L>
ms-rl | title | microsoft reciprocal <L>
cecill | title | cecill(?: [abc])? free software <L>
odbl-1.0 | title | open database <L>
sspl-1.0 | title | server side public <L>
elastic-2.0 | title | elastic <L>
cc0-1.0 | title | creative commons (?:zero|cc0)
cc-by-nc-sa | title | cc by nc sa(?: \d 0)?
cc-by-nc-nd | title | cc by nc nd(?: \d 0)?
cc-by-sa | title | cc by sa(?: \d 0)?
cc-by-nc | title | cc by nc(?: \d 0)?
cc-by-nd | title | cc by nd(?: \d 0)?
cc-by | title | cc by(?: \d 0)
cc-by | base | cc by
cc-by-nc-sa | title | creative commons attribution non ?commercial share ?alike(?: \d 0)?
cc-by-nc-nd | title | creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: \d 0)?
cc-by-sa | title | creative commons attribution share ?alike(?: \d 0)?
cc-by-nc | title | creative commons attribution non ?commercial(?: \d 0)?
cc-by-nd | title | creative commons attribution no ?deriv(?:ative)?s(?: \d 0)?
cc-by | title | creative commons attribution(?: \d 0)?
creative-commons | title | creative commons <L>
gpl-3.0 | mention | gpl v?3(?: 0)?
gpl-2.0 | mention | gpl v?2(?: 0)?
gpl-3.0 | mention | gplv3
gpl-2.0 | mention | gplv2
lgpl | mention | lgpl(?: \d)?(?: \d)?
agpl | mention | agpl(?: \d)?(?: \d)?
cc0-1.0 | mention | cc0(?: 1 0)?
public-domain | mention | public domain
all-rights-reserved | mention | all rights reserved
"""
