"""Signature rules of licences, in order: keyword | priority | label | pattern.

A pattern is tried where the lower-cased text holds the keyword, or the folded text the folded keyword (see `licenses`). Priority 3 is a tag or a fixed sentence, 2 a licence with its
version, 1 a family, 0 a general mention. S stands for what may part two words.
"""

from __future__ import annotations

from typing import NamedTuple

#: Between words: up to eight signs or blanks, so that comment marks and line ends do not hide a phrase.
SEPARATOR = r"[^0-9A-Za-z]{1,8}"

_RULES = r"""
spdx | 3 | spdx-apache-2.0 | spdx-license-identifier:\s*apache-2\.0\b
spdx | 3 | spdx-mit | spdx-license-identifier:\s*mit\b
spdx | 3 | spdx-bsd-2-clause | spdx-license-identifier:\s*bsd-2-clause\b
spdx | 3 | spdx-bsd-3-clause | spdx-license-identifier:\s*bsd-3-clause\b
spdx | 3 | spdx-gpl-2.0-only | spdx-license-identifier:\s*gpl-2\.0(-only)?\b(?!-or|\+)
spdx | 3 | spdx-gpl-2.0-or-later | spdx-license-identifier:\s*gpl-2\.0(-or-later\b|\+)
spdx | 3 | spdx-gpl-3.0-only | spdx-license-identifier:\s*gpl-3\.0(-only)?\b(?!-or|\+)
spdx | 3 | spdx-gpl-3.0-or-later | spdx-license-identifier:\s*gpl-3\.0(-or-later\b|\+)
spdx | 3 | spdx-lgpl-2.1 | spdx-license-identifier:\s*lgpl-2\.1[-+a-z]{0,9}
spdx | 3 | spdx-lgpl-3.0 | spdx-license-identifier:\s*lgpl-3\.0[-+a-z]{0,9}
spdx | 3 | spdx-agpl-3.0 | spdx-license-identifier:\s*agpl-3\.0[-+a-z]{0,9}
spdx | 3 | spdx-mpl-2.0 | spdx-license-identifier:\s*mpl-2\.0\b
spdx | 3 | spdx-epl-2.0 | spdx-license-identifier:\s*epl-2\.0\b
spdx | 3 | spdx-isc | spdx-license-identifier:\s*isc\b
spdx | 3 | spdx-zlib | spdx-license-identifier:\s*zlib\b
spdx | 3 | spdx-unlicense | spdx-license-identifier:\s*unlicense\b
spdx | 3 | spdx-cc0-1.0 | spdx-license-identifier:\s*cc0-1\.0\b
spdx | 3 | spdx-cc-by-4.0 | spdx-license-identifier:\s*cc-by-4\.0\b
spdx | 3 | spdx-cc-by-sa-4.0 | spdx-license-identifier:\s*cc-by-sa-4\.0\b
spdx | 3 | spdx-bsl-1.0 | spdx-license-identifier:\s*bsl-1\.0\b
spdx | 3 | spdx-0bsd | spdx-license-identifier:\s*0bsd\b
spdx | 3 | spdx-wtfpl | spdx-license-identifier:\s*wtfpl\b
spdx | 3 | spdx-python-2.0 | spdx-license-identifier:\s*(python|psf)-2\.0\b
spdx | 3 | spdx-artistic-2.0 | spdx-license-identifier:\s*artistic-2\.0\b
spdx | 0 | spdx-other | spdx-license-identifier:\s*[0-9a-z][-.+0-9a-z]{1,40}
apache | 3 | apache-2.0 | licensedSunderStheSapacheSlicense[^0-9A-Za-z]{1,8}versionS2\.0
apache | 3 | apache-2.0 | www\.apache\.org/licenses/license-2\.0
apache | 3 | apache-1.1 | apacheSsoftwareSlicense[^0-9A-Za-z]{1,8}versionS1\.1
apache | 3 | apache-1.0 | apacheSsoftwareSlicense[^0-9A-Za-z]{1,8}versionS1\.0
apache | 2 | apache-2.0 | apache(S(software|public))?Slicense[^0-9A-Za-z]{1,8}v(ersion)?[^0-9A-Za-z]{0,3}2(\.0)?\b
apache | 2 | apache-2.0 | apache[-_ ]?2(\.0)?\b
apache | 2 | apache-2.0 | \basl[-_ ]?2\.0\b.{0,40}apache
apache | 1 | apache | apacheS(software|public)Slicense\b
apache | 1 | apache | apacheSlicense\b
apache | 0 | apache-foundation | apacheSsoftwareSfoundation\b
permission is hereby granted | 3 | mit | permissionSisSherebySgranted[^0-9A-Za-z]{1,8}freeSofScharge[^0-9A-Za-z]{1,8}toSanySpersonSobtainingSaScopySofSthisSsoftware
permission is hereby granted | 2 | mit-style | permissionSisSherebySgranted[^0-9A-Za-z]{1,8}freeSofScharge
permission is hereby granted | 2 | mit-no-attribution | permissionSisSherebySgranted.{0,400}withoutSrestriction.{0,400}sublicense(?!.{0,400}copyrightSnotice)
permission is hereby granted | 1 | boost-style | permissionSisSherebySgranted.{0,80}toSanySpersonSorSorganization
permission is hereby granted | 1 | unicode-style | permissionSisSherebySgranted.{0,120}dataSfilesSand
permission is hereby granted | 0 | permissive-grant | permissionSisSherebySgranted
permission to use | 3 | isc | permissionStoSuse[^0-9A-Za-z]{1,8}copy[^0-9A-Za-z]{1,8}modify[^0-9A-Za-z]{1,8}andSorSdistributeSthisSsoftwareSforSanySpurposeSwithSorSwithoutSfee
permission to use | 3 | 0bsd | permissionStoSuse.{0,120}forSanySpurposeSwithSorSwithoutSfeeSisSherebySgranted[^0-9A-Za-z]{0,4}\s*theSsoftwareSisSprovided
permission to use | 2 | hpnd | permissionStoSuse[^0-9A-Za-z]{1,8}copy[^0-9A-Za-z]{1,8}modify[^0-9A-Za-z]{1,8}andSdistributeSthisSsoftwareSandSitsSdocumentation
permission to use | 1 | historical-permissive | permissionStoSuse[^0-9A-Za-z]{1,8}copy
mit | 2 | mit | \bthe\s+mitSlicense\b
mit | 2 | mit | \bmitSlicen[sc]ed?\b
mit | 2 | mit | (released|licensed|available|distributed|published)SunderS(theS)?(termsSofStheS)?mitS(open[- ]source\s+)?licen[sc]e
mit | 2 | mit | opensource\.org/licenses/mit\b
mit | 2 | mit | licen[sc]e[^0-9A-Za-z]{1,4}mit\b
mit | 2 | mit-0 | \bmit[-_ ]0\b
mit | 1 | mit-or-apache | \bmit\s*(/|or|and)\s*apache[-_ ]?2
x11 | 2 | x11 | \bx11Slicense\b
x11 | 1 | x11 | x11[^0-9A-Za-z]style\s+licen[sc]e
expat | 2 | expat | \bexpatSlicense\b
redistribution and use | 3 | bsd-3-clause | redistributionSandSuseSinSsourceSandSbinarySforms.{0,900}neitherStheSname
redistribution and use | 3 | bsd-2-clause | redistributionSandSuseSinSsourceSandSbinarySforms[^0-9A-Za-z]{1,8}withSorSwithoutSmodification[^0-9A-Za-z]{1,8}areSpermitted
redistribution and use | 2 | bsd-4-clause | redistributionSandSuse.{0,900}allSadvertisingSmaterials
redistribution and use | 1 | bsd-style | redistributionSandSuseSinSsourceSandSbinarySforms
redistribution and use | 1 | bsd-source | redistributionSandSuseSofSthisSsoftwareSinSsource
neither the name | 1 | bsd-no-endorsement | neitherStheSname(s)?SofS.{1,160}mayS(be\s+)?used?StoSendorse
bsd | 2 | bsd-2-clause | \bbsd[-_ ]2[-_ ]clause\b
bsd | 2 | bsd-3-clause | \bbsd[-_ ]3[-_ ]clause\b
bsd | 2 | bsd-4-clause | \bbsd[-_ ]4[-_ ]clause\b
bsd | 2 | bsd-2-clause | (2|two)[-_ ]clause\s+bsd\b
bsd | 2 | bsd-3-clause | (3|three)[-_ ]clause\s+bsd\b
bsd | 2 | bsd-4-clause | (4|four)[-_ ]clause\s+bsd\b
bsd | 2 | bsd-simplified | simplified\s+bsd\b
bsd | 2 | bsd-new | (new|revised|modified)\s+bsd\s+licen[sc]e
bsd | 2 | freebsd | freebsdSlicense\b
bsd | 2 | openbsd | openbsdSlicense\b
bsd | 2 | 0bsd | (zero[-_ ]clause|0)[-_ ]?bsd\b
bsd | 1 | bsd | \bbsdSlicen[sc]ed?\b
bsd | 1 | bsd | bsd[-_ ]style\s+licen[sc]e
bsd | 1 | bsd | opensource\.org/licenses/bsd
general public license | 3 | gpl-3.0 | gnuSgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS3(\.0)?\b
general public license | 3 | gpl-2.0 | gnuSgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS2(\.0)?\b
general public license | 3 | gpl-1.0 | gnuSgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS1(\.0)?\b
general public license | 3 | gpl-3.0-or-later | generalSpublicSlicenseSasSpublishedSbyStheSfreeSsoftwareSfoundation[^0-9A-Za-z]{1,8}eitherSversionS3SofStheSlicense[^0-9A-Za-z]{1,8}or
general public license | 3 | gpl-2.0-or-later | generalSpublicSlicenseSasSpublishedSbyStheSfreeSsoftwareSfoundation[^0-9A-Za-z]{1,8}eitherSversionS2SofStheSlicense[^0-9A-Za-z]{1,8}or
general public license | 3 | lgpl-3.0 | (lesser|library)SgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS3(\.0)?\b
general public license | 3 | lgpl-2.1 | (lesser|library)SgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS2\.1\b
general public license | 3 | lgpl-2.0 | (lesser|library)SgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS2(\.0)?\b(?!\.)
general public license | 3 | agpl-3.0 | afferoSgeneralSpublicSlicense[^0-9A-Za-z]{1,8}versionS3(\.0)?\b
general public license | 2 | agpl | (gnuS)?afferoSgeneralSpublicSlicense\b
general public license | 2 | lgpl | (gnuS)?(lesser|library)SgeneralSpublicSlicense\b
general public license | 1 | gpl | (gnuS)?generalSpublicSlicense\b
general public license | 1 | gpl-exception | generalSpublicSlicense.{0,200}(classpath|linking|runtime\s+library)\s+exception
general public licence | 1 | gpl | (gnuS)?generalSpublicSlicence\b
gpl | 2 | gpl-3.0 | \bgpl[-_ ]?v?(ersion\s+)?3(\.0)?\b
gpl | 2 | gpl-2.0 | \bgpl[-_ ]?v?(ersion\s+)?2(\.0)?\b
gpl | 2 | lgpl-2.1 | \blgpl[-_ ]?v?(ersion\s+)?2\.1\b
gpl | 2 | lgpl-3.0 | \blgpl[-_ ]?v?(ersion\s+)?3(\.0)?\b
gpl | 2 | agpl-3.0 | \bagpl[-_ ]?v?(ersion\s+)?3(\.0)?\b
gpl | 1 | gpl | \bgnu\s+gpl\b
gpl | 1 | gpl | \bgpl[- ]?licen[sc]ed\b
gpl | 1 | lgpl | \blgpl\b
gpl | 1 | agpl | \bagpl\b
gnu.org | 2 | gpl | gnu\.org/licenses/(old-licenses/)?gpl
gnu.org | 2 | lgpl | gnu\.org/licenses/(old-licenses/)?lgpl
gnu.org | 2 | agpl | gnu\.org/licenses/agpl
gnu.org | 2 | gfdl | gnu\.org/licenses/fdl
gnu.org | 0 | gnu | gnu\.org/licenses\b
free documentation | 3 | gfdl-1.3 | freeSdocumentationSlicense[^0-9A-Za-z]{1,8}versionS1\.3\b
free documentation | 3 | gfdl-1.2 | freeSdocumentationSlicense[^0-9A-Za-z]{1,8}versionS1\.2\b
free documentation | 3 | gfdl-1.1 | freeSdocumentationSlicense[^0-9A-Za-z]{1,8}versionS1\.1\b
free documentation | 1 | gfdl | (gnuS)?freeSdocumentationSlicense\b
gfdl | 1 | gfdl | \bgfdl\b
mozilla | 3 | mpl-2.0 | subjectStoStheStermsSofStheSmozillaSpublicSlicense[^0-9A-Za-z]{1,8}v(ersion|\.)?[^0-9A-Za-z]{0,3}2\.0
mozilla | 2 | mpl-2.0 | mozillaSpublicSlicense[^0-9A-Za-z]{1,8}v?(ersionS)?2\.0\b
mozilla | 2 | mpl-1.1 | mozillaSpublicSlicense[^0-9A-Za-z]{1,8}v?(ersionS)?1\.1\b
mozilla | 2 | mpl-1.0 | mozillaSpublicSlicense[^0-9A-Za-z]{1,8}v?(ersionS)?1\.0\b
mozilla | 2 | mpl-2.0 | mozilla\.org/mpl/2\.0
mozilla | 1 | mpl | mozillaSpublicSlicense\b
mpl | 2 | mpl-2.0 | \bmpl[-_ ]?v?2(\.0)?\b
mpl | 2 | mpl-1.1 | \bmpl[-_ ]?v?1\.1\b
eclipse | 2 | epl-2.0 | eclipseSpublicSlicense[^0-9A-Za-z]{1,8}v?(ersionS)?2\.0\b
eclipse | 2 | epl-1.0 | eclipseSpublicSlicense[^0-9A-Za-z]{1,8}v?(ersionS)?1\.0\b
eclipse | 2 | edl-1.0 | eclipseSdistributionSlicense\b
eclipse | 1 | epl | eclipseSpublicSlicense\b
eclipse | 1 | epl | eclipse\.org/legal/epl
common development | 2 | cddl-1.0 | commonSdevelopmentSandSdistributionSlicense.{0,20}1\.0
common development | 2 | cddl-1.1 | commonSdevelopmentSandSdistributionSlicense.{0,20}1\.1
common development | 1 | cddl | commonSdevelopmentSandSdistributionSlicense\b
cddl | 1 | cddl | \bcddl\b
common public license | 1 | cpl-1.0 | commonSpublicSlicense\b
european union public | 2 | eupl-1.2 | europeanSunionSpublicSlicen[sc]e.{0,20}1\.2
european union public | 2 | eupl-1.1 | europeanSunionSpublicSlicen[sc]e.{0,20}1\.1
european union public | 1 | eupl | europeanSunionSpublicSlicen[sc]e\b
eupl | 1 | eupl | \beupl\b
artistic license | 2 | artistic-2.0 | artisticSlicense[^0-9A-Za-z]{1,8}(versionS)?2\.0\b
artistic license | 2 | artistic-1.0 | artisticSlicense[^0-9A-Za-z]{1,8}(versionS)?1\.0\b
artistic license | 1 | artistic | artisticSlicense\b
artistic license | 1 | perl | sameStermsSasSperl.{0,200}artisticSlicense
same terms as perl | 1 | perl | sameStermsSasSperl\b
boost | 2 | bsl-1.0 | boostSsoftwareSlicense[^0-9A-Za-z]{1,8}versionS1\.0\b
boost | 1 | bsl-1.0 | boostSsoftwareSlicense\b
boost | 1 | bsl-1.0 | boost\.org/license_1_0
zlib | 2 | zlib | \bzlib(/libpng)?Slicense\b
zlib | 1 | zlib | zlib[-_ ]style\s+licen[sc]e
provided 'as-is' | 2 | zlib | thisSsoftwareSisSprovided\s+'as-is'[^0-9A-Za-z]{1,8}withoutSanySexpressSorSimpliedSwarranty
libpng | 2 | libpng | \blibpngSlicense\b
unlicense | 3 | unlicense | thisSisSfreeSandSunencumberedSsoftware.{0,400}unlicense
unlicense | 2 | unlicense | \bthe\s+unlicense\b
unlicense | 2 | unlicense | unlicense\.org
unencumbered | 3 | unlicense | thisSisSfreeSandSunencumberedSsoftwareSreleasedSintoStheSpublicSdomain
wtfpl | 2 | wtfpl | \bwtfpl\b
do what the | 2 | wtfpl | doSwhatStheSfuckSyouSwantStoSpublicSlicense
public domain | 2 | public-domain-dedication | (released|placed|dedicated|put)S(in)?(to)?StheSpublicSdomain
public domain | 2 | public-domain-mark | publicSdomainSmark\b
public domain | 1 | public-domain | (isS)?inStheSpublicSdomain
public domain | 0 | public-domain-mention | publicSdomain\b
public domain | 2 | pddl | publicSdomainSdedicationSandSlicense\b
creative commons | 3 | cc-by-nc-nd | creativeScommonsSattribution[^0-9A-Za-z]{1,8}non-?commercial[^0-9A-Za-z]{1,8}no-?deriv(ative|ative\s*work)?s\b
creative commons | 3 | cc-by-nc-sa | creativeScommonsSattribution[^0-9A-Za-z]{1,8}non-?commercial[^0-9A-Za-z]{1,8}share-?alike\b
creative commons | 3 | cc-by-nc | creativeScommonsSattribution[^0-9A-Za-z]{1,8}non-?commercial\b
creative commons | 3 | cc-by-nd | creativeScommonsSattribution[^0-9A-Za-z]{1,8}no-?derivatives?\b
creative commons | 3 | cc-by-sa-4.0 | creativeScommonsSattribution[^0-9A-Za-z]{1,8}share-?alikeS4\.0\b
creative commons | 3 | cc-by-sa-3.0 | creativeScommonsSattribution[^0-9A-Za-z]{1,8}share-?alikeS3\.0\b
creative commons | 3 | cc-by-sa | creativeScommonsSattribution[^0-9A-Za-z]{1,8}share-?alike\b
creative commons | 3 | cc-by-4.0 | creativeScommonsSattributionS4\.0\b
creative commons | 3 | cc-by-3.0 | creativeScommonsSattributionS3\.0\b
creative commons | 2 | cc-by | creativeScommonsSattribution\b
creative commons | 3 | cc0-1.0 | creativeScommonsS(zero|cc0)\b
creative commons | 2 | cc0-1.0 | creativeScommons.{0,30}public\s+domain\s+dedication
creative commons | 1 | creative-commons | creativeScommonsSlicen[sc]ed?\b
creative commons | 0 | creative-commons-mention | creativeScommons\b
creativecommons.org | 3 | cc-by-nc-nd | creativecommons\.org/licenses/by-nc-nd\b
creativecommons.org | 3 | cc-by-nc-sa | creativecommons\.org/licenses/by-nc-sa\b
creativecommons.org | 3 | cc-by-nc | creativecommons\.org/licenses/by-nc/
creativecommons.org | 3 | cc-by-nd | creativecommons\.org/licenses/by-nd\b
creativecommons.org | 3 | cc-by-sa | creativecommons\.org/licenses/by-sa\b
creativecommons.org | 3 | cc-by | creativecommons\.org/licenses/by/
creativecommons.org | 3 | cc0-1.0 | creativecommons\.org/publicdomain/zero\b
creativecommons.org | 3 | public-domain-mark | creativecommons\.org/publicdomain/mark\b
cc0 | 2 | cc0-1.0 | \bcc0([-_ ]1\.0)?\b
cc | 2 | cc-by-nc-nd | \bcc[-_ ]by[-_ ]nc[-_ ]nd\b
cc | 2 | cc-by-nc-sa | \bcc[-_ ]by[-_ ]nc[-_ ]sa\b
cc | 2 | cc-by-nc | \bcc[-_ ]by[-_ ]nc\b
cc | 2 | cc-by-nd | \bcc[-_ ]by[-_ ]nd\b
cc | 2 | cc-by-sa-4.0 | \bcc[-_ ]by[-_ ]sa[-_ ]4\.0\b
cc | 2 | cc-by-sa-3.0 | \bcc[-_ ]by[-_ ]sa[-_ ]3\.0\b
cc | 2 | cc-by-sa | \bcc[-_ ]by[-_ ]sa\b
cc | 2 | cc-by-4.0 | \bcc[-_ ]by[-_ ]4\.0\b
cc | 2 | cc-by-3.0 | \bcc[-_ ]by[-_ ]3\.0\b
cc | 1 | cc-by | \bcc[-_ ]by\b
open database | 2 | odbl-1.0 | openSdatabaseSlicense\b
open data commons | 2 | odc-by | openSdataScommonsSattributionSlicense\b
open data commons | 1 | open-data-commons | openSdataScommons\b
open government | 2 | ogl-uk-3.0 | openSgovernmentSlicen[sc]eS(v|versionS)?3\.0
open government | 1 | ogl-uk | openSgovernmentSlicen[sc]e\b
community data license | 2 | cdla | communitySdataSlicenseSagreement\b
open font | 2 | ofl-1.1 | silSopenSfontSlicense[^0-9A-Za-z]{1,8}versionS1\.1\b
open font | 1 | ofl | (silS)?openSfontSlicense\b
python software foundation | 2 | psf-2.0 | pythonSsoftwareSfoundationSlicense[^0-9A-Za-z]{1,8}versionS2\b
python software foundation | 1 | psf | pythonSsoftwareSfoundationSlicense\b
php license | 2 | php-3.01 | phpSlicense[^0-9A-Za-z]{1,8}versionS3\.01\b
php license | 1 | php | phpSlicense\b
ruby license | 1 | ruby | rubySlicense\b
openssl | 1 | openssl | opensslSlicense\b
isc license | 2 | isc | \biscSlicense\b
ncsa | 2 | ncsa | universitySofSillinois.{0,12}ncsaSopenSsourceSlicense
ncsa | 1 | ncsa | ncsaSopenSsourceSlicense\b
academic free | 2 | afl-3.0 | academicSfreeSlicense[^0-9A-Za-z]{1,8}v(ersion|\.)?[^0-9A-Za-z]{0,3}3\.0
academic free | 1 | afl | academicSfreeSlicense\b
open software license | 2 | osl-3.0 | openSsoftwareSlicense[^0-9A-Za-z]{1,8}v(ersion|\.)?[^0-9A-Za-z]{0,3}3\.0
open software license | 1 | osl | openSsoftwareSlicense\b
microsoft public | 2 | ms-pl | microsoftSpublicSlicense\b
microsoft reciprocal | 2 | ms-rl | microsoftSreciprocalSlicense\b
universal permissive | 2 | upl-1.0 | universalSpermissiveSlicense\b
mulan | 2 | mulanpsl-2.0 | mulanSpermissiveSsoftwareSlicense\b
business source | 2 | busl-1.1 | businessSsourceSlicense\b
server side public | 2 | sspl-1.0 | serverSsideSpublicSlicense\b
elastic license | 2 | elastic-2.0 | elasticSlicenseS2\.0\b
elastic license | 1 | elastic | elasticSlicense\b
commons clause | 2 | commons-clause | commonsSclauseSlicenseScondition\b
commons clause | 1 | commons-clause | commonsSclause\b
openrail | 2 | openrail-m | \b(bigscience\s+|creativeml\s+)?openrail(\+\+)?[-_ ]?m\b
openrail | 1 | openrail | \bopenrail\b
w3c | 1 | w3c | w3cSsoftware(SnoticeSand)?(SandSdocument)?Slicense\b
latex project | 2 | lppl-1.3c | latexSprojectSpublicSlicense.{0,20}1\.3c
latex project | 1 | lppl | latexSprojectSpublicSlicense\b
all rights reserved | 1 | all-rights-reserved | allSrightsSreserved\b
some rights reserved | 1 | some-rights-reserved | someSrightsSreserved\b
no rights reserved | 1 | no-rights-reserved | noSrightsSreserved\b
proprietary | 1 | proprietary | proprietaryS(andSconfidential|software|license)\b
confidential | 1 | proprietary | confidentialSandSproprietary\b
all rights | 0 | rights-notice | allSrights\b
copyright | 1 | copyright-notice | copyright\s*(\(c\)|©)?\s*(19|20)\d\d\b
copyright | 0 | copyright-mention | copyright(ed)?\s+by\b
licensed under | 0 | licence-mention | licensedSunderS(theS)?[0-9A-Za-z]{2,20}
licenced under | 0 | licence-mention | licencedSunderS(theS)?[0-9A-Za-z]{2,20}
terms of the | 0 | licence-terms | underStheStermsSofStheS[0-9A-Za-z]{2,20}(S[0-9A-Za-z]{2,20}){0,3}Slicen[sc]e
see license | 0 | licence-file | seeSlicen[sc]e(\.(txt|md))?\b
license file | 0 | licence-file | licen[sc]eSfile\b
end user license | 1 | eula | endSuserSlicen[sc]eSagreement\b
eula | 1 | eula | \beula\b
without warranty | 0 | warranty-disclaimer | withoutSwarrantySofSanySkind
as is | 0 | warranty-disclaimer | provided\s+["']?as\s+is["']?
non-commercial use | 1 | non-commercial | forSnon-commercialSuseSonly
noncommercial | 1 | non-commercial | \bnoncommercialS(use|purposes)\b
research purposes only | 1 | research-only | forSresearchSpurposesSonly
educational use | 1 | educational-only | forSeducationalSuseSonly
personal use | 1 | personal-use-only | forSpersonalSuseSonly
royalty-free | 0 | royalty-free | royalty-freeSlicen[sc]e
open source license | 0 | open-source-mention | openSsourceSlicen[sc]ed?\b
open-source license | 0 | open-source-mention | open-sourceSlicen[sc]ed?\b
shareware | 1 | shareware | \bshareware\b
freeware | 1 | freeware | \bfreeware\b
beerware | 2 | beerware | \bbeerware\b|the\s+beer-ware\s+license
"""


class Rule(NamedTuple):
    keyword: str
    priority: int
    label: str
    pattern: str


def rules() -> list[Rule]:
    out = []
    for line in _RULES.strip().splitlines():
        keyword, priority, label, pattern = (x.strip() for x in line.split(" | ", 3))
        out.append(Rule(keyword, int(priority), label, "(?is)" + pattern.replace(r"\S", "\0").replace("S", SEPARATOR).replace("\0", r"\S")))
    return out
