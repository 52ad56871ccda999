"""Signatures of licenses, written by hand: one rule a line.

label | priority | confidence | keywords, one of which any match holds | regular expression

Rules are matched over words in lower case, A-Z made a-z, with single spaces in
place of all that is no letter or digit: 'GPL-3.0-or-later' is 'gpl 3 0 or
later'. Priorities: 5 machine-readable tags, 4 notices and sentences of the
license itself, 3 a name with its version, 2 a name, 1 what tells that there are
terms, 0 what may. The order of lines decides between equal ones.
"""

SIGNATURES = r"""
apache-2.0|5|1.0|spdx license|spdx license identifier apache 2 0
apache-2.0|4|0.98|apache license|licensed under the apache license version 2 0
apache-2.0|4|0.97|apache org|apache org licenses license 2 0
apache-2.0|4|0.9|compliance with the license|you may not use this file except in compliance with the license
apache-2.0|4|0.9|writing software distributed|unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
apache-2.0|3|0.95|apache|apache(?: software)? licen[cs]e(?: version| v| ver)? ?2(?: 0)?
apache-2.0|3|0.95|apache|apache(?: software)? licen[cs]e v2(?: 0)?
apache-2.0|3|0.9|apache|apache (?:v ?)?2(?: 0)?(?: licen[cs]ed?| license)
apache-2.0|3|0.85|apache 2 0|apache 2 0
apache-2.0|3|0.8|apache2|apache2(?: 0)?(?: licen[cs]ed?)?
apache-2.0|3|0.8|asl 2|(?:licen[cs]e )?asl 2 0
apache-1.1|3|0.9|apache|apache(?: software)? licen[cs]e(?: version| v)? 1 1
apache-1.0|3|0.9|apache|apache(?: software)? licen[cs]e(?: version| v)? 1 0
apache|4|0.85|apache software foundation|licensed to the apache software foundation(?: asf)? under one or more
apache|2|0.7|apache|apache(?: software)?(?: foundation)? licen[cs]ed?
apache|2|0.6|apache|(?:licensed|released|distributed|available|published) under (?:the )?apache
mit|5|1.0|spdx license|spdx license identifier mit
mit|4|0.98|permission is hereby|permission is hereby granted free of charge to any person obtaining a copy of this software
mit|4|0.9|copies or substantial|copyright notice and this permission notice shall be included in all copies or substantial portions of the software
mit|4|0.97|opensource|opensource org licenses? mit(?: license)?(?: php| html)?
mit|3|0.9|mit,expat,x11|(?:licensed|released|distributed|available|published|provided|offered|covered) (?:under|by|with) (?:the )?(?:terms of the )?(?:standard |permissive )?(?:mit|expat|x11)
mit|3|0.85|mit x11|mit x11(?: style)?(?: licen[cs]ed?)?
mit|3|0.85|expat|expat licen[cs]ed?
mit|3|0.8|x11 licen|x11 licen[cs]ed?
mit|3|0.85|mit|(?:the )?mit(?: open source| style| type)? licen[cs](?:e|ed|ing)
mit|3|0.85|mit|licen[cs]e (?:is |type )?mit
mit|3|0.8|dual|dual licen[cs]ed (?:under )?(?:the )?mit
mit|3|0.8|mit|(?:either )?mit or apache
mit|3|0.8|apache|apache 2 0 (?:or|and) mit
mit|3|0.8|mit|licen[cs]ed mit
mit-0|5|1.0|spdx license|spdx license identifier mit 0
mit-0|3|0.9|mit no attribution|mit no attribution(?: licen[cs]e)?
mit-0|3|0.8|mit 0|(?:licen[cs]e|under) (?:the )?mit 0(?: licen[cs]e)?
isc|5|1.0|spdx license|spdx license identifier isc
isc|4|0.97|permission to use|permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted
isc|3|0.85|isc|(?:the )?isc(?: style)? licen[cs]ed?
isc|3|0.8|isc|licen[cs]e isc
isc|3|0.8|internet|internet (?:systems|software) consortium licen[cs]e
gpl-2.0|5|1.0|spdx license|spdx license identifier gpl 2 0(?: only| or later)?
gpl-3.0|5|1.0|spdx license|spdx license identifier gpl 3 0(?: only| or later)?
gpl-1.0|5|1.0|spdx license|spdx license identifier gpl 1 0(?: only| or later)?
gpl-2.0|4|0.97|gnu general|gnu general public licen[cs]e as published by the free software foundation (?:either )?version 2
gpl-3.0|4|0.97|gnu general|gnu general public licen[cs]e as published by the free software foundation (?:either )?version 3
gpl-2.0|3|0.95|general public|(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v| ver)? ?v?2(?: 0)?
gpl-3.0|3|0.95|general public|(?:gnu )?general public licen[cs]e(?: gpl)?(?: version| v| ver)? ?v?3(?: 0)?
gpl-2.0|3|0.9|gpl|(?:gnu )?gpl ?v ?2(?: 0)?(?: only| or later| or any later version)?
gpl-3.0|3|0.9|gpl|(?:gnu )?gpl ?v ?3(?: 0)?(?: only| or later| or any later version)?
gpl-2.0|3|0.9|gpl 2|(?:gnu )?gpl 2(?: 0)?(?: only| or later)?
gpl-3.0|3|0.9|gpl 3|(?:gnu )?gpl 3(?: 0)?(?: only| or later)?
gpl-2.0|3|0.85|gpl version 2|(?:gnu )?gpl version 2(?: 0)?
gpl-3.0|3|0.85|gpl version 3|(?:gnu )?gpl version 3(?: 0)?
gpl-2.0|3|0.8|gpl2|gpl2(?: 0)?
gpl-3.0|3|0.8|gpl3|gpl3(?: 0)?
gpl|4|0.95|redistribute it|you can redistribute it and or modify it under the terms of the gnu general public licen[cs]e
gpl|4|0.9|gnu general|you should have received a copy of the gnu general public licen[cs]e along with
gpl|4|0.9|gnu org|gnu org (?:licenses|copyleft) gpl
gpl|3|0.75|classpath|(?:gpl|general public licen[cs]e) with (?:the )?classpath exception
gpl|2|0.8|general public|(?:the )?gnu general public licen[cs]e
gpl|2|0.6|general public|general public licen[cs]e
gpl|2|0.75|gnu gpl|(?:the )?gnu gpl
gpl|2|0.7|gpl|(?:licensed|released|distributed|available|published|covered) (?:under|by) (?:the )?(?:terms of the )?(?:gnu )?gpl
gpl|2|0.7|gpl|gpl licen[cs]ed?
gpl|2|0.7|gpl|licen[cs]e gpl
gpl|2|0.6|gpl compatible|gpl compatible
lgpl-2.1|5|1.0|spdx license|spdx license identifier lgpl 2 1(?: only| or later)?
lgpl-3.0|5|1.0|spdx license|spdx license identifier lgpl 3 0(?: only| or later)?
lgpl-2.0|5|1.0|spdx license|spdx license identifier lgpl 2 0(?: only| or later)?
lgpl-2.1|3|0.95|lesser general|(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation either)?(?: version| v)? v?2 1
lgpl-3.0|3|0.95|lesser general|(?:gnu )?lesser general public licen[cs]e(?: lgpl)?(?: as published by the free software foundation either)?(?: version| v)? v?3(?: 0)?
lgpl-2.0|3|0.95|library general|(?:gnu )?library general public licen[cs]e(?: lgpl)?(?: version| v)? v?2(?: 0)?
lgpl-2.1|3|0.9|lgpl|(?:gnu )?lgpl ?(?:v |version )?v?2 1(?: only| or later)?
lgpl-3.0|3|0.9|lgpl|(?:gnu )?lgpl ?(?:v |version )?v?3(?: 0)?(?: only| or later)?
lgpl|4|0.95|redistribute it|you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public licen[cs]e
lgpl|4|0.9|gnu org|gnu org (?:licenses|copyleft) lgpl
lgpl|3|0.8|lesser general|(?:gnu )?lesser general public licen[cs]e
lgpl|3|0.8|library general|(?:gnu )?library general public licen[cs]e
lgpl|2|0.75|lgpl|(?:gnu )?lgpl(?: licen[cs]ed?)?
agpl-3.0|5|1.0|spdx license|spdx license identifier agpl 3 0(?: only| or later)?
agpl-3.0|3|0.95|affero|(?:gnu )?affero general public licen[cs]e(?: agpl)?(?: as published by the free software foundation either)?(?: version| v)? v?3(?: 0)?
agpl-3.0|3|0.9|agpl|(?:gnu )?agpl ?(?:v |version )?v?3(?: 0)?(?: only| or later)?
agpl|4|0.95|redistribute it|you can redistribute it and or modify it under the terms of the gnu affero general public licen[cs]e
agpl|4|0.9|gnu org|gnu org licenses agpl
agpl|3|0.8|affero|(?:gnu )?affero (?:general public )?licen[cs]e
agpl|2|0.75|agpl|(?:gnu )?agpl(?: licen[cs]ed?)?
gfdl-1.3|3|0.95|free documentation|(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 3
gfdl-1.2|3|0.95|free documentation|(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 2
gfdl-1.1|3|0.95|free documentation|(?:gnu )?free documentation licen[cs]e(?: version| v)? 1 1
gfdl|4|0.9|document under|permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation licen[cs]e
gfdl|2|0.8|free documentation|(?:gnu )?free documentation licen[cs]e
gfdl|2|0.7|gfdl|(?:gnu )?gfdl(?: \d \d)?
gfdl|4|0.9|gnu org|gnu org (?:licenses|copyleft) fdl
bsd-3-clause|5|1.0|spdx license|spdx license identifier bsd 3 clause
bsd-2-clause|5|1.0|spdx license|spdx license identifier bsd 2 clause
bsd-0-clause|5|1.0|spdx license|spdx license identifier 0bsd
bsd-3-clause|4|0.95|endorse or promote|neither the names? of (?:\S+ ){1,12}nor the names of (?:its|their|the) contributors may be used to endorse or promote products
bsd-4-clause|4|0.95|advertising materials|all advertising materials mentioning features or use of this software must display
bsd|4|0.95|redistribution and use|redistribution and use in source and binary forms with or without modification (?:are|is) permitted
bsd|4|0.9|redistributions of source|redistributions of source code must retain the above copyright notice
bsd|4|0.9|redistributions in binary|redistributions in binary form must reproduce the above copyright notice
bsd-3-clause|3|0.9|bsd|bsd 3 clause(?: licen[cs]ed?)?
bsd-3-clause|3|0.9|bsd|(?:3|three) clause bsd(?: style)?(?: licen[cs]ed?)?
bsd-3-clause|3|0.85|bsd|(?:new|modified|revised) bsd(?: licen[cs]ed?)?
bsd-3-clause|3|0.8|bsd3|bsd3
bsd-2-clause|3|0.9|bsd|bsd 2 clause(?: licen[cs]ed?)?
bsd-2-clause|3|0.9|bsd|(?:2|two) clause bsd(?: style)?(?: licen[cs]ed?)?
bsd-2-clause|3|0.85|bsd|(?:simplified bsd|freebsd) licen[cs]ed?
bsd-2-clause|3|0.8|bsd2|bsd2
bsd-4-clause|3|0.9|bsd|(?:bsd 4 clause|(?:4|four) clause bsd|original bsd licen[cs]e|old bsd licen[cs]e)(?: licen[cs]ed?)?
bsd-0-clause|3|0.9|bsd|(?:zero clause bsd|bsd zero clause|0bsd)(?: licen[cs]ed?)?
bsd|4|0.9|opensource|opensource org licenses? bsd(?: license| \d clause)?
bsd|2|0.8|bsd|(?:the )?bsd(?: style| type| like)? licen[cs](?:e|ed|ing)
bsd|2|0.75|bsd|(?:licensed|released|distributed|available|published) under (?:a |the )?(?:terms of the )?bsd
bsd|2|0.75|bsd|licen[cs]e bsd
mpl-2.0|5|1.0|spdx license|spdx license identifier mpl 2 0
mpl-1.1|5|1.0|spdx license|spdx license identifier mpl 1 1
mpl-2.0|4|0.97|source code form|this source code form is subject to the terms of the mozilla public licen[cs]e v(?:ersion)? ?2 0
mpl-2.0|4|0.95|mozilla org|mozilla org (?:en us )?mpl 2 0
mpl-1.1|4|0.95|mozilla org|mozilla org mpl mpl 1 1
mpl-1.1|4|0.95|mozilla public|the contents of this file are subject to the mozilla public licen[cs]e version 1 1
mpl-2.0|3|0.95|mozilla public|mozilla public licen[cs]e(?: mpl)?(?: version| v)? ?v?2(?: 0)?
mpl-1.1|3|0.95|mozilla public|mozilla public licen[cs]e(?: mpl)?(?: version| v)? ?v?1 1
mpl-1.0|3|0.95|mozilla public|mozilla public licen[cs]e(?: mpl)?(?: version| v)? ?v?1 0
mpl-2.0|3|0.9|mpl|mpl ?(?:v ?|version )?2(?: 0)?
mpl-1.1|3|0.9|mpl|mpl ?(?:v ?|version )?1 1
mpl|2|0.8|mozilla public|mozilla public licen[cs]e
mpl|2|0.7|mpl|(?:under the mpl|mpl licen[cs]ed?|licen[cs]e mpl)
epl-2.0|5|1.0|spdx license|spdx license identifier epl 2 0
epl-1.0|5|1.0|spdx license|spdx license identifier epl 1 0
epl-2.0|3|0.95|eclipse|eclipse public licen[cs]e(?: epl)?(?: version| v)? ?v?2(?: 0)?
epl-1.0|3|0.95|eclipse|eclipse public licen[cs]e(?: epl)?(?: version| v)? ?v?1(?: 0)?
epl-2.0|3|0.9|epl 2|epl 2 0
epl-1.0|3|0.9|epl 1|epl 1 0
epl|4|0.9|eclipse|this program and the accompanying materials are made available under the terms of the eclipse public licen[cs]e
epl|4|0.9|eclipse org|eclipse org legal epl
epl|2|0.8|eclipse|eclipse public licen[cs]e
edl|2|0.8|eclipse|eclipse distribution licen[cs]e(?: v ?1 0)?
cddl-1.1|3|0.9|cddl|cddl(?: version| v)? 1 1
cddl-1.0|3|0.9|cddl|cddl(?: version| v)? 1 0
cddl|5|1.0|spdx license|spdx license identifier cddl 1 [01]
cddl|3|0.9|common development|common development and distribution licen[cs]e
cddl|2|0.75|cddl|cddl(?: licen[cs]ed?)?
cpl-1.0|3|0.9|common public|common public licen[cs]e(?: version| v)? 1 0
cpl|2|0.75|common public|common public licen[cs]e
cpal|2|0.85|common public|common public attribution licen[cs]e(?: version 1 0)?
eupl-1.2|5|1.0|spdx license|spdx license identifier eupl 1 2
eupl-1.2|3|0.9|eupl|eupl ?(?:version |v ?)?1 2
eupl-1.1|3|0.9|eupl|eupl ?(?:version |v ?)?1 1
eupl|2|0.85|european union public|european union public licen[cs]e
eupl|2|0.75|eupl|(?:under the eupl|eupl licen[cs]ed?|licen[cs]e eupl)
osl-3.0|3|0.9|open software|open software licen[cs]e(?: osl)?(?: version| v)? ?3 0
osl-3.0|3|0.85|osl 3|osl 3 0
osl|2|0.75|open software|open software licen[cs]e
afl-3.0|3|0.9|academic free|academic free licen[cs]e(?: afl)?(?: version| v)? ?3 0
afl-2.1|3|0.9|academic free|academic free licen[cs]e(?: afl)?(?: version| v)? ?2 1
afl|2|0.8|academic free|academic free licen[cs]e
artistic-2.0|5|1.0|spdx license|spdx license identifier artistic 2 0
artistic-2.0|3|0.9|artistic|artistic licen[cs]e(?: version| v)? ?2(?: 0)?
artistic-1.0|3|0.9|artistic|artistic licen[cs]e(?: version| v)? ?1(?: 0)?
artistic-2.0|3|0.85|artistic 2 0|artistic 2 0
artistic|4|0.85|same terms as perl|(?:redistribute it|use it|distributed)(?: and or modify it)? under the same terms as perl(?: itself)?
artistic|2|0.8|artistic licen|(?:perl )?artistic licen[cs]e
bsl-1.0|5|1.0|spdx license|spdx license identifier bsl 1 0
bsl-1.0|4|0.95|boost|distributed under the boost software licen[cs]e(?: version 1 0)?
bsl-1.0|4|0.9|boost org|boost org license 1 0 txt
bsl-1.0|3|0.9|boost|boost(?: software)? licen[cs]e(?: version 1 0| 1 0)?
bsl-1.0|3|0.8|bsl 1 0|(?:licen[cs]e|under the) bsl 1 0
busl-1.1|5|1.0|spdx license|spdx license identifier busl 1 1
busl-1.1|3|0.9|business source|business source licen[cs]e(?: version)?(?: 1 1)?
busl-1.1|3|0.85|busl 1 1|busl 1 1
sspl-1.0|5|1.0|spdx license|spdx license identifier sspl 1 0
sspl-1.0|3|0.9|server side public|server side public licen[cs]e(?: sspl)?(?: version| v)?(?: ?v?1(?: 0)?)?
sspl-1.0|2|0.8|sspl|sspl(?: v1| 1 0)?
elastic-2.0|5|1.0|spdx license|spdx license identifier elastic 2 0
elastic-2.0|3|0.9|elastic licen|elastic licen[cs]e(?: version| v)?(?: ?v?2(?: 0)?)?
ofl-1.1|5|1.0|spdx license|spdx license identifier ofl 1 1
ofl-1.1|4|0.95|font software|this font software is licensed under the sil open font licen[cs]e(?: version 1 1)?
ofl-1.1|4|0.9|scripts sil org|scripts sil org ofl
ofl-1.1|3|0.9|open font|(?:sil )?open font licen[cs]e(?: ofl)?(?: version| v)?(?: 1 1)?
ofl-1.1|3|0.8|sil ofl|sil ofl(?: 1 1)?
ofl-1.1|3|0.8|ofl 1 1|ofl 1 1
zlib|5|1.0|spdx license|spdx license identifier zlib
zlib|4|0.95|any damages arising|in no event will the authors? be held liable for any damages arising from the use of this software
zlib|4|0.9|origin of this software|the origin of this software must not be misrepresented
zlib|3|0.85|zlib,libpng|(?:zlib libpng|zlib|libpng) licen[cs]ed?
psf-2.0|5|1.0|spdx license|spdx license identifier (?:psf|python) 2 0
psf|3|0.85|python software|python software foundation licen[cs]e(?: version 2)?
psf|3|0.8|psf|psf licen[cs]e
psf|2|0.7|python license|(?:the )?python license
php-3.01|3|0.9|php|php licen[cs]e(?: version| v)? ?3 01
php|2|0.7|php licen|(?:the )?php licen[cs]e
ruby|2|0.75|ruby|(?:the )?ruby(?: s)? licen[cs]e
ms-pl|5|1.0|spdx license|spdx license identifier ms pl
ms-pl|3|0.9|microsoft public|microsoft public licen[cs]e(?: ms pl)?
ms-pl|3|0.75|ms pl|ms pl(?: licen[cs]ed?)?
ms-rl|3|0.9|microsoft reciprocal|microsoft reciprocal licen[cs]e(?: ms rl)?
unlicense|5|1.0|spdx license|spdx license identifier unlicense
unlicense|4|0.97|free and unencumbered|this is free and unencumbered software released into the public domain
unlicense|4|0.9|unlicense org|unlicense org
unlicense|3|0.85|unlicense|(?:the )?unlicense(?:d)?(?: license)?
wtfpl|5|1.0|spdx license|spdx license identifier wtfpl
wtfpl|3|0.9|what the fuck|do what the fuck you want to public licen[cs]e
wtfpl|2|0.85|wtfpl|(?:the )?wtfpl(?: licen[cs]ed?)?(?: v ?2| version 2)?
cc0-1.0|5|1.0|spdx license|spdx license identifier cc0 1 0
cc0-1.0|4|0.95|creativecommons org|creativecommons org publicdomain zero 1 0
cc0-1.0|3|0.9|cc0|cc0(?: 1 0)?(?: universal)?(?: licen[cs]ed?)?
cc0-1.0|3|0.9|creative commons|creative commons (?:cc )?zero(?: 1 0)?(?: licen[cs]e)?
cc0-1.0|3|0.85|public domain dedication|cc (?:zero|0) (?:\S+ ){0,3}public domain dedication
cc-by-nc-nd|3|0.95|cc by|cc by nc nd(?: \d \d)?
cc-by-nc-sa|3|0.95|cc by|cc by nc sa(?: \d \d)?
cc-by-nc|3|0.95|cc by|cc by nc(?: \d \d)?
cc-by-sa|3|0.95|cc by|cc by sa(?: \d \d)?
cc-by-nd|3|0.95|cc by|cc by nd(?: \d \d)?
cc-by|3|0.95|cc by|cc by \d \d
cc-by|2|0.85|cc by|cc by
cc-by-nc-nd|4|0.97|creativecommons org|creativecommons org licenses by nc nd(?: \d \d)?
cc-by-nc-sa|4|0.97|creativecommons org|creativecommons org licenses by nc sa(?: \d \d)?
cc-by-nc|4|0.97|creativecommons org|creativecommons org licenses by nc(?: \d \d)?
cc-by-sa|4|0.97|creativecommons org|creativecommons org licenses by sa(?: \d \d)?
cc-by-nd|4|0.97|creativecommons org|creativecommons org licenses by nd(?: \d \d)?
cc-by|4|0.97|creativecommons org|creativecommons org licenses by(?: \d \d)?
cc-by-nc-nd|3|0.95|creative commons|creative commons attribution non ?commercial no ?deriv(?:ative|ative work|atives|s)?(?: works)?
cc-by-nc-sa|3|0.95|creative commons|creative commons attribution non ?commercial share ?alike
cc-by-nc|3|0.95|creative commons|creative commons attribution non ?commercial
cc-by-sa|3|0.95|creative commons|creative commons attribution share ?alike
cc-by-nd|3|0.95|creative commons|creative commons attribution no ?deriv(?:ative|ative work|atives|s)?(?: works)?
cc-by|3|0.9|creative commons|creative commons attribution(?: \d \d)?(?: international| unported| generic)?(?: public)?(?: licen[cs]e)?
creative-commons|1|0.5|creative commons|creative commons(?: licen[cs]ed?)?
cecill|3|0.85|cecill|(?:under the )?cecill(?: [bc])?(?: free software)?(?: licen[cs]e)?(?: \d \d)?
ecl-2.0|3|0.85|educational community|educational community licen[cs]e(?: version)?(?: 2 0)?
ncsa|3|0.85|ncsa|(?:university of illinois )?(?:ncsa )(?:open source )?licen[cs]e
odbl-1.0|3|0.9|open database,database licen|open (?:data commons )?(?:open )?database licen[cs]e(?: odbl)?(?: v ?1 0)?
odbl-1.0|3|0.85|odbl|odbl(?: 1 0)?
odc-by|3|0.85|open data commons|open data commons attribution licen[cs]e
pddl-1.0|3|0.85|open data commons|open data commons public domain dedication and licen[cs]e
openssl|3|0.85|openssl|openssl licen[cs]e
openssl|4|0.9|openssl project|this product includes software developed by the openssl project
postgresql|3|0.85|postgresql|postgresql licen[cs]e
vim|3|0.8|vim|vim licen[cs]e
w3c|3|0.85|w3c|w3c(?: software)?(?: notice and)?(?: document)? licen[cs]e
curl|3|0.85|curl|curl licen[cs]e
json|4|0.9|good not evil|the software shall be used for good not evil
beerware|4|0.9|beer|(?:the )?beer ?ware licen[cs]e
beerware|4|0.9|buy me a beer|you can buy me a beer in return
llama|3|0.85|llama|llama (?:2 |3 |3 1 )?community licen[cs]e(?: agreement)?
openrail|3|0.85|rail|(?:creativeml |bigscience |bigcode )?open ?rail(?: m)?(?: licen[cs]e)?
hippocratic|3|0.85|hippocratic|hippocratic licen[cs]e
commons-clause|3|0.85|commons clause|commons clause(?: license)?(?: condition)?
fair-source|3|0.8|fair source|fair source licen[cs]e
oracle-bcl|3|0.8|oracle binary code|oracle binary code licen[cs]e(?: agreement)?
public-domain|3|0.85|public domain|(?:released|placed|put|dedicated|donated) (?:in|into|to|in to) the public domain
public-domain|3|0.8|public domain|dedicate (?:any and all )?(?:\S+ ){1,6}to the public domain
public-domain|2|0.5|public domain|(?:is|are|was) in the public domain
public-domain|2|0.6|public domain|licen[cs]e public domain
proprietary|3|0.8|proprietary and confidential|(?:is )?proprietary and confidential
proprietary|3|0.75|unauthorized|unauthorized (?:copying|reproduction|use|distribution)(?: or distribution)? of this (?:\S+ ){0,3}is (?:strictly )?prohibited
proprietary|3|0.7|end user licen|end user licen[cs]e agreement
proprietary|1|0.4|rights reserved|all rights reserved
copyleft|1|0.4|copyleft|(?:strong |weak )?copyleft(?: licen[cs]ed?)?
warranty|1|0.3|without warranty|without warranty of any kind express or implied
warranty|1|0.3|without any warranty|without any warranty without even the implied warranty of
unknown-license|1|0.4|spdx license|spdx license identifier
unknown-license|0|0.3|licensed under|(?:dual |triple )?licensed under
unknown-license|0|0.3|under|(?:released|distributed|available|published|provided) under (?:the |an? )?(?:\S+ ){1,4}licen[cs]e
unknown-license|0|0.3|license|see (?:the )?(?:accompanying )?license(?: txt| md)? file
unknown-license|0|0.3|licence|see (?:the )?(?:accompanying )?licence(?: txt| md)? file
unknown-license|0|0.3|license agreement|subject to (?:the )?(?:terms of )?(?:the |this |a )?license agreement
"""
