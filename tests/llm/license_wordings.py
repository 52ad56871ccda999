"""Label and wording of license lines as they are met in headers, manifests, read-mes and notices; none: of no license."""

WORDINGS = """
gpl-3.0: Released under GPLv3
gpl-3.0: SPDX: GPL-3.0-or-later
mit: This is MIT licensed
bsd-3-clause: BSD-3-Clause
apache-2.0: License: Apache-2.0
mit: dual licensed MIT/Apache-2.0
bsd: Redistributions of source code must retain the above copyright notice, this list of conditions
apache-2.0: "license": "Apache-2.0",
mit: "license": "MIT",
mit: license = "MIT"
mit: licensed under the terms of the MIT license
mit: Distributed under the MIT License. See LICENSE for more information.
mit: This project is licensed under the MIT License - see the LICENSE.md file
mit: [MIT](LICENSE) License
mit: MIT-licensed
mit: The code is available under the MIT license.
mit: Everything in this repository is under the MIT Licence
mit: released under the permissive MIT license
mit: // Use of this source code is governed by an MIT-style license that can be found in the LICENSE file
mit: License :: OSI Approved :: MIT License
mit: # SPDX-License-Identifier: MIT
mit: /* SPDX-License-Identifier: MIT */
mit: https://opensource.org/licenses/MIT
mit: http://www.opensource.org/licenses/mit-license.php
mit: Copyright (c) 2019 The Authors. The MIT License (MIT)
mit: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
mit: Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files
mit: you may use it under either the MIT licence or the GPL
mit: Expat licence, see debian/copyright
mit: Licensed under MIT or Apache 2.0, at your option
mit: MIT OR Apache-2.0
mit: Apache-2.0 OR MIT
mit: License: MIT/X11
mit: provided under the X11 license
mit-0: SPDX-License-Identifier: MIT-0
mit-0: MIT No Attribution
isc: ISC License
isc: "license": "ISC"
isc: Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
isc: Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted
isc: SPDX-License-Identifier: ISC
isc: Released under the ISC licence.
isc: This is ISC-licensed code
apache-2.0: Licensed under the Apache License, Version 2.0 (the "License");
apache-2.0: you may not use this file except in compliance with the License.
apache-2.0: http://www.apache.org/licenses/LICENSE-2.0
apache-2.0: Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
apache-2.0: Apache License 2.0
apache-2.0: Apache License v2.0
apache-2.0: The Apache Software License, Version 2.0
apache-2.0: Apache 2.0 licensed
apache-2.0: Apache-2.0 License
apache-2.0: Code is under the Apache 2 license
apache-2.0: License: Apache2
apache-2.0: License :: OSI Approved :: Apache Software License v2
apache-2.0: SPDX-License-Identifier: Apache-2.0
apache-2.0: SPDX-License-Identifier: Apache-2.0 WITH LLVM-exception
apache-2.0: the ASL 2.0 applies
apache-2.0: available under Apache v2 license
apache-2.0: License: ASL 2.0
apache-1.1: The Apache Software License, Version 1.1
apache: Licensed to the Apache Software Foundation (ASF) under one or more contributor license agreements.
apache: It is distributed under the Apache license.
apache: Apache licensed, as ever
gpl-2.0: GPLv2
gpl-2.0: GPL v2 only
gpl-2.0: GPL-2.0-only
gpl-2.0: License: GPL-2+
gpl-2.0: GNU General Public License v2.0
gpl-2.0: GNU General Public License, version 2
gpl-2.0: GNU GPL version 2
gpl-2.0: MODULE_LICENSE("GPL v2");
gpl-2.0: SPDX-License-Identifier: GPL-2.0
gpl-2.0: SPDX-License-Identifier: GPL-2.0-only WITH Linux-syscall-note
gpl-2.0: under the terms of the GNU General Public License as published by the Free Software Foundation; version 2 of the License
gpl-2.0: licensed under the GPL2
gpl-3.0: GNU GPLv3 or later
gpl-3.0: GPL v3
gpl-3.0: gpl-3.0
gpl-3.0: GNU General Public License v3 or later (GPLv3+)
gpl-3.0: GNU General Public License (GPL), version 3
gpl-3.0: the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or
gpl-3.0: SPDX-License-Identifier: GPL-3.0-or-later
gpl-3.0: GPLv3+
gpl-3.0: This file is GPL3
gpl-3.0: This add-on is GPL version 3
gpl: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
gpl: You should have received a copy of the GNU General Public License along with this program.
gpl: see <https://www.gnu.org/licenses/gpl.html>
gpl: it is covered by the GNU GPL
gpl: This module is GPL licensed.
gpl: MODULE_LICENSE("GPL");
gpl: released under the GPL
gpl: GNU general public licence
gpl: GPL with the classpath exception
gpl: the general public license applies here
lgpl-2.1: LGPL-2.1-or-later
lgpl-2.1: GNU LGPL v2.1
lgpl-2.1: LGPLv2.1+
lgpl-2.1: SPDX-License-Identifier: LGPL-2.1
lgpl-2.1: GNU Lesser General Public License, version 2.1
lgpl-3.0: LGPLv3
lgpl-3.0: GNU Lesser General Public License v3.0
lgpl-3.0: SPDX-License-Identifier: LGPL-3.0-only
lgpl-2.0: GNU Library General Public License version 2
lgpl: modify it under the terms of the GNU Lesser General Public License as published by
lgpl: licensed under the LGPL
lgpl: http://www.gnu.org/copyleft/lgpl.html
agpl-3.0: AGPL-3.0
agpl-3.0: GNU AGPLv3
agpl-3.0: GNU Affero General Public License v3.0
agpl-3.0: SPDX-License-Identifier: AGPL-3.0-or-later
agpl: modify it under the terms of the GNU Affero General Public License
agpl: The server is AGPL licensed
gfdl-1.2: GNU Free Documentation License, Version 1.2
gfdl-1.3: licensed under the GNU Free Documentation License version 1.3
gfdl: Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License
gfdl: GFDL 1.3
bsd-3-clause: 3-clause BSD license
bsd-3-clause: New BSD License
bsd-3-clause: the Modified BSD License
bsd-3-clause: Three-Clause BSD
bsd-3-clause: SPDX-License-Identifier: BSD-3-Clause
bsd-3-clause: "license": "BSD-3-Clause"
bsd-3-clause: Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
bsd-3-clause: Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived
bsd-2-clause: BSD 2-Clause License
bsd-2-clause: Simplified BSD License
bsd-2-clause: FreeBSD license
bsd-2-clause: SPDX-License-Identifier: BSD-2-Clause
bsd-4-clause: BSD-4-Clause
bsd-4-clause: All advertising materials mentioning features or use of this software must display the following acknowledgement
bsd-0-clause: 0BSD
bsd-0-clause: BSD Zero Clause License
bsd: Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.
bsd: Redistribution and use in source and binary forms, with or without modification, are permitted
bsd: Redistributions in binary form must reproduce the above copyright notice
bsd: BSD licensed
bsd: License: BSD
bsd: released under a BSD license
bsd: License :: OSI Approved :: BSD License
mpl-2.0: MPL-2.0
mpl-2.0: Mozilla Public License 2.0 (MPL 2.0)
mpl-2.0: This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
mpl-2.0: http://mozilla.org/MPL/2.0/
mpl-2.0: SPDX-License-Identifier: MPL-2.0
mpl-1.1: The contents of this file are subject to the Mozilla Public License Version 1.1
mpl-1.1: MPL 1.1/GPL 2.0/LGPL 2.1
mpl: the Mozilla Public License
epl-2.0: Eclipse Public License v2.0
epl-2.0: EPL-2.0
epl-1.0: Eclipse Public License - v 1.0
epl: made available under the terms of the Eclipse Public License which accompanies this distribution
cddl-1.0: CDDL-1.0
cddl: Common Development and Distribution License
eupl-1.2: EUPL-1.2
eupl-1.2: Licensed under the EUPL v1.2
eupl: European Union Public Licence
osl-3.0: Open Software License (OSL 3.0)
afl-3.0: Academic Free License v3.0
artistic-2.0: Artistic License 2.0
artistic-2.0: Artistic-2.0
artistic: This library is free software; you can redistribute it and/or modify it under the same terms as Perl itself.
bsl-1.0: Distributed under the Boost Software License, Version 1.0.
bsl-1.0: http://www.boost.org/LICENSE_1_0.txt
bsl-1.0: BSL-1.0 license, see the Boost Software License
busl-1.1: Business Source License 1.1
sspl-1.0: Server Side Public License (SSPL) v1
sspl-1.0: SSPL-1.0
elastic-2.0: Elastic License 2.0
ofl-1.1: SIL Open Font License, Version 1.1
ofl-1.1: This Font Software is licensed under the SIL Open Font License
ofl-1.1: http://scripts.sil.org/OFL
zlib: zlib License
zlib: zlib/libpng license
zlib: In no event will the authors be held liable for any damages arising from the use of this software.
zlib: The origin of this software must not be misrepresented; you must not claim
psf: Python Software Foundation License
php-3.01: PHP License v3.01
ms-pl: Microsoft Public License (MS-PL)
unlicense: This is free and unencumbered software released into the public domain.
unlicense: For more information, please refer to <http://unlicense.org/>
unlicense: Released under the Unlicense
wtfpl: DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE
wtfpl: WTFPL v2
cc0-1.0: CC0 1.0 Universal
cc0-1.0: https://creativecommons.org/publicdomain/zero/1.0/
cc0-1.0: released under CC0
cc0-1.0: Creative Commons Zero
cc-by: Creative Commons Attribution 4.0 International License
cc-by: CC BY 4.0
cc-by: CC-BY-4.0
cc-by: https://creativecommons.org/licenses/by/4.0/
cc-by-sa: CC BY-SA 3.0
cc-by-sa: Creative Commons Attribution-ShareAlike 3.0 Unported
cc-by-sa: https://creativecommons.org/licenses/by-sa/4.0/
cc-by-nc: CC-BY-NC 4.0
cc-by-nc: Creative Commons Attribution-NonCommercial
cc-by-nc-sa: CC BY-NC-SA
cc-by-nc-sa: Creative Commons Attribution-NonCommercial-ShareAlike 4.0
cc-by-nc-nd: CC BY-NC-ND 4.0
cc-by-nd: Creative Commons Attribution-NoDerivatives
creative-commons: published with a Creative Commons license
odbl-1.0: Open Database License (ODbL)
openssl: OpenSSL License
postgresql: PostgreSQL License
cecill: CeCILL-B Free Software License
ncsa: University of Illinois/NCSA Open Source License
json: The Software shall be used for Good, not Evil.
beerware: THE BEER-WARE LICENSE
llama: Llama 2 Community License Agreement
openrail: CreativeML Open RAIL-M
commons-clause: Commons Clause License Condition v1.0
public-domain: This work is in the public domain.
public-domain: The author has placed this in the public domain
public-domain: dedicated to the public domain
proprietary: All rights reserved.
proprietary: Unauthorized copying of this file, via any medium, is strictly prohibited
proprietary: Proprietary and confidential
proprietary: End User License Agreement
copyleft: it is a copyleft work
unknown-license: distributed under the terms of the license
unknown-license: See the accompanying LICENSE file for terms.
none: She studied at MIT for four years.
none: The Apache helicopter flew over the valley.
none: A gnu is a large antelope.
none: He took poetic licence with the story.
none: Your driver's license has expired.
none: a licence to kill
none: The domain of the function is the real line.
none: She gave him permission to leave early.
none: The House of Commons met on Monday.
none: The warranty covers parts for a year.
none: Seats are reserved for members.
none: He was a man of artistic taste.
none: beer and good bread
none: submit the form by May
"""
