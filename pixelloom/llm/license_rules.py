"""The signature rules of the license scan, written by hand.

A rule is a line `priority label | keyword | regex`. Rules run on normalised
text: words in lower case joined by single spaces, so "CC BY-NC 4.0" reads "cc
by nc 4 0". A rule is tried only where its keyword is contained; the keyword
is part of whatever the regex matches. Priorities: 1 a notice or statement, 2 a
name with its version, 3 a name, 4 a hint.
"""

RULE_LINES = r"""
1 apache-2.0 | apache license | licensed under the apache license( version)? 2( 0)?
1 apache-2.0 | apache license | licensed to the apache software foundation asf under one or more contributor license agreements .{0,400}apache license version 2 0
1 apache-2.0 | apache org licenses license | apache org licenses license 2 0
1 apache-1.1 | apache software license | licensed under the apache software license version 1 1
1 apache-1.0 | apache software license | licensed under the apache software license version 1 0
2 apache-2.0 | apache | apache( software)? license( version| v)? 2( 0)?
2 apache-2.0 | apache 2 | apache 2( 0)? licen[cs]ed?
2 apache-2.0 | spdx license identifier apache | spdx license identifier apache 2 0
2 apache-1.1 | apache | apache( software)? license( version| v)? 1 1
2 apache-1.0 | apache | apache( software)? license( version| v)? 1 0
3 apache | apache license | apache license
3 apache | apache software license | apache software license
1 mit | mit license | (released|licensed|distributed|available|provided) under (the )?(terms of the )?mit license
1 mit | permission is hereby granted | permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files
1 mit | mit license | license mit license
2 mit | spdx license identifier mit | spdx license identifier mit
2 mit-0 | spdx license identifier mit 0 | spdx license identifier mit 0
2 mit-0 | mit no attribution | mit no attribution( license)?
3 mit | mit license | (the )?mit license
3 mit | mit licensed | mit licensed
3 mit | expat license | expat license
3 mit | x11 license | x11 license
4 mit | the above copyright notice and this permission notice | the above copyright notice and this permission notice shall be included
4 permissive | provided as is without warranty | provided as is without warranty of any kind
1 bsd | redistribution and use in source and binary forms | redistribution and use in source and binary forms with or without modification are permitted
1 bsd | bsd license | (released|licensed|distributed|available) under (the |a )?(terms of the )?bsd license
1 bsd-3-clause | neither the name of | neither the name of .{1,80} nor the names of its contributors may be used to endorse
1 bsd-4-clause | all advertising materials mentioning | all advertising materials mentioning features or use of this software must display
2 bsd-3-clause | bsd 3 clause | bsd 3 clause( license)?
2 bsd-3-clause | 3 clause bsd | 3 clause bsd( license)?
2 bsd-2-clause | bsd 2 clause | bsd 2 clause( license)?
2 bsd-2-clause | 2 clause bsd | 2 clause bsd( license)?
2 bsd-4-clause | bsd 4 clause | bsd 4 clause( license)?
2 bsd-3-clause | new bsd license | new bsd license
2 bsd-3-clause | modified bsd license | modified bsd license
2 bsd-2-clause | simplified bsd license | simplified bsd license
2 bsd-2-clause | freebsd license | freebsd license
2 bsd-0-clause | zero clause bsd | zero clause bsd( license)?
2 bsd-0-clause | spdx license identifier 0bsd | spdx license identifier 0bsd
2 bsd-1-clause | spdx license identifier bsd 1 clause | spdx license identifier bsd 1 clause
2 bsd-2-clause | spdx license identifier bsd 2 clause | spdx license identifier bsd 2 clause
2 bsd-3-clause | spdx license identifier bsd 3 clause | spdx license identifier bsd 3 clause
2 bsd-4-clause | spdx license identifier bsd 4 clause | spdx license identifier bsd 4 clause
3 bsd | bsd license | bsd license
3 bsd | bsd style license | bsd style license
1 isc | isc license | (released|licensed|distributed|available) under (the )?isc license
1 isc | permission to use copy modify and or distribute | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
2 isc | spdx license identifier isc | spdx license identifier isc
3 isc | isc license | isc license
1 gpl-3.0 | general public license | licensed under the (gnu )?general public license version 3( 0)?
1 gpl-2.0 | general public license | licensed under the (gnu )?general public license version 2( 0)?
1 gpl-3.0-or-later | general public license | terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
1 gpl-2.0-or-later | general public license | terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
1 gpl-2.0 | general public license | terms of the gnu general public license version 2 as published by the free software foundation
1 gpl | general public license | you should have received a copy of the gnu general public license
2 gpl-3.0-or-later | general public license | general public license( version| v)? 3( 0)? or (any )?later
2 gpl-2.0-or-later | general public license | general public license( version| v)? 2( 0)? or (any )?later
2 gpl-3.0 | general public license | general public license( version| v)? 3( 0)?
2 gpl-2.0 | general public license | general public license( version| v)? 2( 0)?
2 gpl-1.0 | general public license | general public license( version| v)? 1( 0)?
2 gpl-3.0 | gpl | gplv3
2 gpl-2.0 | gpl | gplv2
2 gpl-3.0-or-later | gpl | gplv3 or later
2 gpl-2.0-or-later | gpl | gplv2 or later
2 gpl-3.0 | gpl | gpl( version| v)? 3( 0)?
2 gpl-2.0 | gpl | gpl( version| v)? 2( 0)?
2 gpl-3.0-only | spdx license identifier gpl | spdx license identifier gpl 3 0 only
2 gpl-3.0-or-later | spdx license identifier gpl | spdx license identifier gpl 3 0 or later
2 gpl-2.0-only | spdx license identifier gpl | spdx license identifier gpl 2 0 only
2 gpl-2.0-or-later | spdx license identifier gpl | spdx license identifier gpl 2 0 or later
3 gpl | general public license | (gnu )?general public license
3 gpl | gpl | (gnu )?gpl
1 lgpl | lesser general public license | you should have received a copy of the gnu lesser general public license
1 lgpl-2.1-or-later | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
1 lgpl-3.0-or-later | lesser general public license | terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version
2 lgpl-3.0 | lesser general public license | (gnu )?lesser general public license( version| v)? 3( 0)?
2 lgpl-2.1 | lesser general public license | (gnu )?lesser general public license( version| v)? 2 1
2 lgpl-2.0 | library general public license | (gnu )?library general public license( version| v)? 2( 0)?
2 lgpl-3.0 | lgpl | lgplv3|lgpl( version| v)? 3( 0)?
2 lgpl-2.1 | lgpl | lgpl( version| v)? 2 1
2 lgpl-3.0-or-later | spdx license identifier lgpl | spdx license identifier lgpl 3 0 or later
2 lgpl-2.1-or-later | spdx license identifier lgpl | spdx license identifier lgpl 2 1 or later
3 lgpl | lesser general public license | (gnu )?lesser general public license
3 lgpl | library general public license | (gnu )?library general public license
3 lgpl | lgpl | (gnu )?lgpl
1 agpl | affero general public license | you should have received a copy of the gnu affero general public license
1 agpl-3.0 | affero general public license | licensed under the (gnu )?affero general public license version 3( 0)?
2 agpl-3.0 | affero general public license | (gnu )?affero general public license( version| v)? 3( 0)?
2 agpl-3.0 | agpl | agplv3|agpl( version| v)? 3( 0)?
2 agpl-3.0-or-later | spdx license identifier agpl | spdx license identifier agpl 3 0 or later
2 agpl-3.0-only | spdx license identifier agpl | spdx license identifier agpl 3 0 only
3 agpl | affero general public license | (gnu )?affero general public license
3 agpl | agpl | (gnu )?agpl
1 gfdl | free documentation license | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
2 gfdl-1.3 | free documentation license | (gnu )?free documentation license( version| v)? 1 3
2 gfdl-1.2 | free documentation license | (gnu )?free documentation license( version| v)? 1 2
2 gfdl-1.1 | free documentation license | (gnu )?free documentation license( version| v)? 1 1
3 gfdl | free documentation license | (gnu )?free documentation license
3 gfdl | gfdl license | gfdl licensed?
1 cc-by-4.0 | cc by | licensed under (a )?cc by 4 0
1 cc-by-3.0 | cc by | licensed under (a )?cc by 3 0
1 cc-by-sa-4.0 | cc by sa | licensed under (a )?cc by sa 4 0
1 cc-by-sa-3.0 | cc by sa | licensed under (a )?cc by sa 3 0
1 cc-by-nc-4.0 | cc by nc | licensed under (a )?cc by nc 4 0
1 cc-by-nc-3.0 | cc by nc | licensed under (a )?cc by nc 3 0
1 cc-by-nd-4.0 | cc by nd | licensed under (a )?cc by nd 4 0
1 cc-by-nc-sa-4.0 | cc by nc sa | licensed under (a )?cc by nc sa 4 0
1 cc-by-nc-nd-4.0 | cc by nc nd | licensed under (a )?cc by nc nd 4 0
2 cc-by-4.0 | cc by | cc by 4 0
2 cc-by-3.0 | cc by | cc by 3 0
2 cc-by-2.5 | cc by | cc by 2 5
2 cc-by-2.0 | cc by | cc by 2 0
2 cc-by-1.0 | cc by | cc by 1 0
2 cc-by-sa-4.0 | cc by sa | cc by sa 4 0
2 cc-by-sa-3.0 | cc by sa | cc by sa 3 0
2 cc-by-sa-2.5 | cc by sa | cc by sa 2 5
2 cc-by-sa-2.0 | cc by sa | cc by sa 2 0
2 cc-by-nc-4.0 | cc by nc | cc by nc 4 0
2 cc-by-nc-3.0 | cc by nc | cc by nc 3 0
2 cc-by-nc-2.5 | cc by nc | cc by nc 2 5
2 cc-by-nc-2.0 | cc by nc | cc by nc 2 0
2 cc-by-nd-4.0 | cc by nd | cc by nd 4 0
2 cc-by-nd-3.0 | cc by nd | cc by nd 3 0
2 cc-by-nc-sa-4.0 | cc by nc sa | cc by nc sa 4 0
2 cc-by-nc-sa-3.0 | cc by nc sa | cc by nc sa 3 0
2 cc-by-nc-nd-4.0 | cc by nc nd | cc by nc nd 4 0
2 cc-by-nc-nd-3.0 | cc by nc nd | cc by nc nd 3 0
3 cc-by | cc by | cc by
3 cc-by-sa | cc by sa | cc by sa
3 cc-by-nc | cc by nc | cc by nc
3 cc-by-nd | cc by nd | cc by nd
3 cc-by-nc-sa | cc by nc sa | cc by nc sa
3 cc-by-nc-nd | cc by nc nd | cc by nc nd
2 cc-by-4.0 | creative commons attribution | creative commons attribution( international)? 4 0( international)?( license)?
2 cc-by-3.0 | creative commons attribution | creative commons attribution 3 0( unported)?( license)?
2 cc-by-sa-4.0 | creative commons attribution share | creative commons attribution share ?alike 4 0( international)?( license)?
2 cc-by-sa-3.0 | creative commons attribution share | creative commons attribution share ?alike 3 0( unported)?( license)?
2 cc-by-nc-4.0 | creative commons attribution non | creative commons attribution non ?commercial 4 0( international)?( license)?
2 cc-by-nc-3.0 | creative commons attribution non | creative commons attribution non ?commercial 3 0( unported)?( license)?
2 cc-by-nd-4.0 | creative commons attribution no | creative commons attribution no ?deriv(ative)?s 4 0( international)?( license)?
2 cc-by-nc-sa-4.0 | creative commons attribution non | creative commons attribution non ?commercial share ?alike 4 0( international)?( license)?
2 cc-by-nc-sa-3.0 | creative commons attribution non | creative commons attribution non ?commercial share ?alike 3 0( unported)?( license)?
2 cc-by-nc-nd-4.0 | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(ative)?s 4 0( international)?( license)?
3 cc-by | creative commons attribution | creative commons attribution( license)?
3 cc-by-sa | creative commons attribution share | creative commons attribution share ?alike( license)?
3 cc-by-nc | creative commons attribution non | creative commons attribution non ?commercial( license)?
3 cc-by-nd | creative commons attribution no | creative commons attribution no ?deriv(ative)?s( license)?
3 cc-by-nc-sa | creative commons attribution non | creative commons attribution non ?commercial share ?alike( license)?
3 cc-by-nc-nd | creative commons attribution non | creative commons attribution non ?commercial no ?deriv(ative)?s( license)?
2 cc-by-4.0 | creativecommons org licenses by | creativecommons org licenses by 4 0
2 cc-by-3.0 | creativecommons org licenses by | creativecommons org licenses by 3 0
2 cc-by-sa-4.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 4 0
2 cc-by-sa-3.0 | creativecommons org licenses by sa | creativecommons org licenses by sa 3 0
2 cc-by-nc-4.0 | creativecommons org licenses by nc | creativecommons org licenses by nc 4 0
2 cc-by-nd-4.0 | creativecommons org licenses by nd | creativecommons org licenses by nd 4 0
2 cc-by-nc-sa-4.0 | creativecommons org licenses by nc sa | creativecommons org licenses by nc sa 4 0
2 cc-by-nc-nd-4.0 | creativecommons org licenses by nc nd | creativecommons org licenses by nc nd 4 0
2 cc0-1.0 | creativecommons org publicdomain zero | creativecommons org publicdomain zero 1 0
2 cc0-1.0 | cc0 | cc0 1 0( universal)?
2 cc0-1.0 | spdx license identifier cc0 | spdx license identifier cc0 1 0
3 cc0 | cc0 | cc0
3 cc0 | creative commons zero | creative commons zero
4 creative-commons | creative commons | creative commons( license)?
1 mpl-2.0 | mozilla public license | subject to the terms of the mozilla public license v(ersion)? ?2 0
2 mpl-2.0 | mozilla public license | mozilla public license( version| v)? 2( 0)?
2 mpl-1.1 | mozilla public license | mozilla public license( version| v)? 1 1
2 mpl-2.0 | spdx license identifier mpl | spdx license identifier mpl 2 0
3 mpl | mozilla public license | mozilla public license
1 epl-2.0 | eclipse public license | made available under the terms of the eclipse public license( version| v)? 2 0
2 epl-2.0 | eclipse public license | eclipse public license( version| v)? 2 0
2 epl-1.0 | eclipse public license | eclipse public license( version| v)? 1 0
3 epl | eclipse public license | eclipse public license
2 cddl-1.0 | common development and distribution license | common development and distribution license( version| v)? 1 0
2 cddl-1.1 | common development and distribution license | common development and distribution license( version| v)? 1 1
3 cddl | common development and distribution license | common development and distribution license
2 eupl-1.2 | european union public licen | european union public licen[cs]e( version| v)? 1 2
2 eupl-1.1 | european union public licen | european union public licen[cs]e( version| v)? 1 1
3 eupl | european union public licen | european union public licen[cs]e
2 artistic-2.0 | artistic license | artistic license( version| v)? 2 0
2 artistic-1.0 | artistic license | artistic license( version| v)? 1 0
3 artistic | artistic license | artistic license
2 bsl-1.0 | boost software license | boost software license( version| v)? 1 0
3 bsl | boost software license | boost software license
2 busl-1.1 | business source license | business source license( version| v)? 1 1
3 busl | business source license | business source license
2 sspl-1.0 | server side public license | server side public license( version| v)? 1
3 sspl | server side public license | server side public license
3 elastic | elastic license | elastic license( 2 0)?
3 zlib | zlib license | zlib license
2 zlib | spdx license identifier zlib | spdx license identifier zlib
2 python-2.0 | python software foundation license | python software foundation license( version| v)? 2
3 psf | python software foundation license | python software foundation license
3 php | php license | php license( version| v)?( 3 01)?
3 ruby | ruby license | ruby license
3 openssl | openssl license | openssl license
3 unlicense | unlicense | (the )?unlicense
1 unlicense | released into the public domain | this is free and unencumbered software released into the public domain
1 public-domain | public domain | (released|placed|dedicated) (in|into|to) the public domain
3 wtfpl | do what the fuck you want to public license | do what the fuck you want to public license
3 beerware | beerware license | beerware license
3 beerware | beer ware license | beer ware license
3 ofl | open font license | (sil )?open font license( version| v)?( 1 1)?
3 ms-pl | microsoft public license | microsoft public license
3 ms-rl | microsoft reciprocal license | microsoft reciprocal license
3 ibm-public | ibm public license | ibm public license
3 common-public | common public license | common public license
3 odbl | open database license | open database license( odbl)?
3 odc-by | open data commons attribution license | open data commons attribution license
3 pddl | public domain dedication and license | public domain dedication and license
3 ogl | open government licen | open government licen[cs]e( v3 0)?
3 openrail | openrail license | openrail license
3 openrail | openrail m license | openrail m license
3 vim | vim license | vim license
3 postgresql | postgresql license | postgresql license
3 academic-free | academic free license | academic free license
3 open-software | open software license | open software license
4 public-domain | public domain | public domain
4 permission | used by permission | used by permission
4 permission | reprinted with permission | reprinted with permission
4 copyright | copyright c | copyright c (19|20)[0-9][0-9]
4 copyright | copyright | copyright (19|20)[0-9][0-9]
4 copyright | copyright holder | copyright holders?
3 reserved | all rights reserved | all rights reserved
3 reserved | some rights reserved | some rights reserved
3 reserved | no rights reserved | no rights reserved
2 proprietary | confidential and proprietary | confidential and proprietary .{0,80}rights reserved
3 proprietary | proprietary license | proprietary license
3 commercial | commercial license | commercial license
3 non-commercial | non commercial license | non commercial license
3 end-user | end user license agreement | end user license agreement
3 royalty-free | royalty free license | royalty free license
3 copyleft | copyleft | copyleft
4 license | under the terms of the license | under the terms of the license
4 license | see the license file | see the license file
4 license | licensed under | licensed under (a|the) [0-9a-z_]+ license
4 license | spdx license identifier | spdx license identifier [0-9a-z]+( [0-9]+)*
"""

#: Whatever a rule matches contains one of these or CC_ANCHOR, also before normalisation.
ANCHORS = ("licen", "copyright", "copyleft", "reserved", "commons", "public", "permi", "gpl", "bsd", "warranty", "redistribution", "neither", "advertising", "attribution")

CC_ANCHOR = r"cc(?:0|[\x00-\x2F\x3A-\x60\x7B-\x7F]+by)"

#: Score of a detection by its priority.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.6, 4: 0.3}


def parsed() -> list[tuple[int, str, str, str]]:
    """(priority, label, keyword, regex with word bounds), in the order above."""
    out = []
    for line in filter(None, RULE_LINES.split("\n")):
        head, keyword, regex = (x.strip() for x in line.split(" | ", 2))
        priority, label = head.split(" ")
        out.append((int(priority), label, keyword, rf"\b(?:{regex})\b"))
    return out
