"""Signatures from the bodies of licenses: sentences by which a text is known even where no license is named. Label and expression over words.

Words are lower case, without marks: "licensor's" is two. A rule's keyword is the longest stretch of its expression that stands as it is.
"""

BODIES = [
    # Apache 2.0
    ("apache-2.0", r"terms and conditions for use reproduction and distribution 1 definitions license shall mean"),
    ("apache-2.0", r"each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license to reproduce"),
    ("apache-2.0", r"irrevocable except as stated in this section patent license to make have made use offer to sell sell import"),
    ("apache-2.0", r"you must cause any modified files to carry prominent notices stating that you changed the files"),
    ("apache-2.0", r"if the work includes a notice text file as part of its distribution"),
    ("apache-2.0", r"legal entity shall mean the union of the acting entity and all other entities that control"),
    ("apache-2.0", r"unless you explicitly state otherwise any contribution intentionally submitted for inclusion in the work"),
    ("apache-2.0", r"this license does not grant permission to use the trade names trademarks service marks or product names of the licensor"),
    ("apache-2.0", r"while redistributing the work or derivative works thereof you may choose to offer"),
    ("apache-1.1", r"the names? (?:[^ ]+ ){1,8}must not be used to endorse or promote products derived from this software without prior written permission"),
    ("apache-1.1", r"products derived from this software may not be called (?:[^ ]+ ){1,4}nor may"),
    # GNU, version 2
    ("gpl-2.0", r"the licenses for most software are designed to take away your freedom to share and change it"),
    ("gpl-2.0", r"you may copy and distribute verbatim copies of the program s source code as you receive it in any medium"),
    ("gpl-2.0", r"you must cause the modified files to carry prominent notices stating that you changed the files and the date of any change"),
    ("gpl-2.0", r"mere aggregation of another work not based on the program with the program"),
    ("gpl-2.0", r"accompany it with a written offer valid for at least three years to give any third party"),
    ("gpl-2.0", r"you are not required to accept this license since you have not signed it"),
    ("gpl-2.0", r"if the distribution and or use of the program is restricted in certain countries either by patents or by copyrighted interfaces"),
    ("gpl-2.0", r"because the program is licensed free of charge there is no warranty for the program"),
    ("gpl-2.0", r"this general public license does not permit incorporating your program into proprietary programs"),
    # GNU, version 3
    ("gpl-3.0", r"the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-3.0", r"to propagate a work means to do anything with it that without permission"),
    ("gpl-3.0", r"to convey a work means any kind of propagation that enables other parties to make or receive copies"),
    ("gpl-3.0", r"no covered work shall be deemed part of an effective technological measure"),
    ("gpl-3.0", r"a user product is either 1 a consumer product which means any tangible personal property"),
    ("gpl-3.0", r"installation information for a user product means any methods procedures authorization keys"),
    ("gpl-3.0", r"a patent license is discriminatory if it does not include within the scope of its coverage"),
    ("gpl-3.0", r"developers that use the gnu gpl protect your rights with two steps"),
    ("gpl-3.0", r"all rights granted under this license are granted for the term of copyright on the program and are irrevocable"),
    ("gpl-3.0", r"you may not impose any further restrictions on the exercise of the rights granted or affirmed under this license"),
    ("gpl", r"everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("gpl", r"when we speak of free software we are referring to freedom not price"),
    ("gpl", r"type show w this is free software and you are welcome to redistribute it under certain conditions"),
    # GNU, others
    ("lgpl-2.1", r"this license the lesser general public license applies to some specially designated software packages"),
    ("lgpl-2.1", r"a program that contains no derivative of any portion of the library but is designed to work with the library"),
    ("lgpl-2.1", r"the modified work must itself be a software library"),
    ("lgpl-3.0", r"this version of the gnu lesser general public license incorporates the terms and conditions of version 3"),
    ("lgpl-3.0", r"a combined work is a work produced by combining or linking an application with the library"),
    ("agpl-3.0", r"specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", r"the gnu affero general public license is a free copyleft license"),
    ("gfdl", r"permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("gfdl", r"with no invariant sections no front cover texts and no back cover texts"),
    ("gfdl", r"the purpose of this license is to make a manual textbook or other functional and useful document free"),
    ("gpl-exception", r"linking this library statically or dynamically with other modules is making a combined work"),
    ("gpl-exception", r"as a special exception (?:[^ ]+ ){1,20}gives? (?:you )?(?:permission|unlimited permission) to (?:link|copy)"),
    # BSD, MIT and their kin
    ("bsd", r"in no event shall the copyright (?:holders?|owners?) or contributors be liable for any direct indirect incidental special exemplary or consequential damages"),
    ("bsd", r"this software is provided by (?:the )?(?:[^ ]+ ){1,12}as is and any express or implied warranties including but not limited to"),
    ("bsd-3-clause-clear", r"no express or implied licenses to any party s patent rights are granted by this license"),
    ("bsd-3-clause", r"the names? of (?:the )?(?:authors?|university|contributors) may not be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-1-clause", r"redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer this software is provided"),
    ("bsd-patent", r"each copyright holder and contributor hereby grants to those receiving rights under this license a perpetual worldwide"),
    ("mit", r"in no event shall the authors or copyright holders be liable for any claim damages or other liability"),
    ("mit", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies"),
    ("mit-feh", r"the above copyright notice and this permission notice shall be included in all copies of the software and its documentation"),
    ("mit-modern", r"permission is hereby granted without written agreement and without license or royalty fees"),
    ("isc", r"the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"),
    ("isc", r"in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever"),
    ("ntp", r"permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted"),
    ("hpnd", r"makes no representations about the suitability of this software for any purpose"),
    ("x11", r"x window system is a trademark of"),
    ("curl", r"permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided"),
    ("postgresql", r"specifically disclaims any warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose the software provided hereunder is on an as is basis"),
    ("w3c", r"by obtaining using and or copying this work you the licensee agree that you have read understood and will comply"),
    ("unicode", r"a copy of the unicode data files and any associated documentation"),
    ("icu", r"provided that the above copyright notices? and this permission notice appear in all copies of the software and that both"),
    ("ncsa", r"redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimers in the documentation"),
    ("ncsa", r"developed by (?:[^ ]+ ){1,12}university of illinois"),
    ("blue-oak", r"this license gives everyone as much permission to work with this software as possible"),
    ("blue-oak", r"each contributor licenses you to do everything with this software that would otherwise infringe"),
    # Mozilla and its descendants
    ("mpl-2.0", r"covered software means source code form to which the initial contributor has attached the notice"),
    ("mpl-2.0", r"this source code form is incompatible with secondary licenses"),
    ("mpl-2.0", r"larger work means a work that combines covered software with other material in a separate file or files"),
    ("mpl-2.0", r"the licenses granted in section 2 1 with respect to any contribution become effective for each contribution on the date"),
    ("mpl-1.1", r"the initial developer of the original code is"),
    ("mpl-1.1", r"software distributed under the license is distributed on an as is basis without warranty of any kind either express or implied see the license for the specific language governing rights and limitations"),
    ("mpl-1.1", r"alternatively the contents of this file may be used under the terms of"),
    ("cddl", r"covered software means a the original software or b modifications"),
    ("cddl-1.0", r"when distributing covered code include this cddl header in each file"),
    ("cddl", r"you can obtain a copy of the license at (?:[^ ]+ ){1,6}cddl"),
    ("epl-1.0", r"the accompanying program is provided under the terms of this eclipse public license agreement"),
    ("epl-2.0", r"secondary license means either the gnu general public license version 2 0 or any later versions of that license"),
    ("epl", r"any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cpl-1.0", r"the accompanying program is provided under the terms of this common public license agreement"),
    ("osl-3.0", r"licensed under the open software license version 3 0"),
    ("osl", r"grant of source code license the term source code means the preferred form of the original work for making modifications"),
    ("osl", r"external deployment the term external deployment means the use distribution or communication of the original work"),
    ("afl-3.0", r"licensed under the academic free license version 3 0"),
    ("eupl-1.2", r"this european union public licence the eupl applies to the work as defined below"),
    ("eupl", r"the licensor hereby grants you a worldwide royalty free non exclusive sublicensable licence to do the following"),
    ("cecill", r"this agreement is a free software license agreement that is the result of discussions between its authors"),
    ("cecill", r"the exercise of these rights is conditional upon certain obligations for users"),
    ("mulan-psl-2.0", r"you can use this software according to the terms and conditions of the mulan psl ?v2"),
    ("mulan-psl-1.0", r"you can use this software according to the terms and conditions of the mulan psl ?v1"),
    ("upl-1.0", r"the above copyright notice and either this complete permission notice or at a minimum a reference to the upl must be included"),
    ("ms-pl", r"if you bring a patent claim against any contributor over patents that you claim are infringed by the software"),
    ("ms-rl", r"reciprocal grants for any file you distribute that contains code from the software"),
    ("qpl-1.0", r"you may copy this license document but may not alter it in any way this license document may be freely copied"),
    ("qpl-1.0", r"the intent of this license is to establish freedom to share and change the software regulated by this license under the open source model"),
    ("sleepycat", r"redistributions in any form must be accompanied by information on how to obtain complete source code"),
    ("apsl-2.0", r"this file contains original code and or modifications of original code as defined in and that are subject to the apple public source license"),
    ("sgi-b-2.0", r"the above copyright notice including the dates of first publication and either this permission notice or a reference to"),
    # Zlib, Boost, image libraries
    ("zlib", r"permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely"),
    ("zlib", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("zlib", r"this notice may not be removed or altered from any source distribution"),
    ("zlib-acknowledgement", r"an acknowledgment in the product documentation would be appreciated but is not required"),
    ("boost-1.0", r"unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("boost-1.0", r"must be included in all copies of the software in whole or in part and all derivative works of the software"),
    ("libpng", r"the contributing authors and group 42 inc disclaim all warranties"),
    ("libpng", r"the png reference library is supplied as is"),
    ("ijg", r"this software is based in part on the work of the independent jpeg group"),
    ("libtiff", r"permission to use copy modify distribute and sell this software and its documentation for any purpose is hereby granted without fee"),
    ("freetype", r"portions of this software are copyright (?:[^ ]+ ){0,6}the freetype project"),
    ("bzip2", r"altered source versions must be plainly marked as such and must not be misrepresented as being the original software 4 the name of the author"),
    ("info-zip", r"this software is provided as is without warranty of any kind express or implied in no event shall info zip or its contributors be held liable"),
    # Languages and projects
    ("python-2.0", r"this license agreement is between the python software foundation psf and the individual or organization licensee"),
    ("python-2.0", r"psf is making python available to licensee on an as is basis"),
    ("cnri", r"cnri open source license agreement"),
    ("cnri", r"corporation for national research initiatives having an office at"),
    ("php-3.0", r"products derived from this software may not be called php nor may php appear in their name"),
    ("zend-2.0", r"the zend engine (?:is )?(?:available|license)"),
    ("zend-2.0", r"this product includes the zend engine freely available at"),
    ("ruby", r"you may make and give away verbatim copies of the source form of the software without restriction"),
    ("ruby", r"rename any non standard executables so the names do not conflict with standard executables"),
    ("artistic-2.0", r"this license establishes the terms under which a given free software package may be copied modified distributed and or redistributed"),
    ("artistic-1.0", r"you may otherwise modify your copy of this package in any way provided that you insert a prominent notice in each changed file"),
    ("openssl", r"the names openssl toolkit and openssl project must not be used to endorse or promote products derived from this software"),
    ("ssleay", r"this product includes cryptographic software written by eric young"),
    ("vim", r"there are no restrictions on distributing unmodified copies of vim"),
    ("tcl", r"the authors hereby grant permission to use copy modify distribute and license this software and its documentation for any purpose"),
    ("zpl-2.1", r"this license has been certified as open source"),
    ("zpl-2.1", r"zope public license zpl version"),
    ("json", r"the software shall be used for good"),
    ("wtfpl", r"everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long as the name is changed"),
    ("ofl-1.1", r"the goals of the open font license ofl are to stimulate worldwide development of collaborative font projects"),
    ("ofl-1.1", r"neither the font software nor any of its individual components in original or modified versions may be sold by itself"),
    ("ofl-1.1", r"no modified version of the font software may use the reserved font names?"),
    ("llvm-exception", r"as an exception if as a result of your compiling your source code portions of this software are embedded into an object form"),
    ("classpath-exception", r"link this library with independent modules to produce an executable regardless of the license terms of these independent modules"),
    # Creative Commons and data
    ("cc-by", r"attribution you must give appropriate credit provide a link to the license"),
    ("cc-by", r"the licensor permits others to copy distribute and transmit the work in return licensees must give the original author credit"),
    ("cc-by-4.0", r"by exercising the licensed rights defined below you accept and agree to be bound by the terms and conditions of this creative commons"),
    ("cc-by-3.0", r"the work as defined below is provided under the terms of this creative commons public license"),
    ("cc-by-sa", r"adapter s license means the license you apply to your copyright and similar rights in your contributions to adapted material"),
    ("cc-by-sa", r"if you alter transform or build upon this work you may distribute the resulting work only under the same or similar license"),
    ("cc-by-nc", r"noncommercial means not primarily intended for or directed towards commercial advantage or monetary compensation"),
    ("cc0-1.0", r"affirmer overtly fully permanently irrevocably and unconditionally waives abandons and surrenders"),
    ("cc0-1.0", r"the person who associated a work with this deed has dedicated the work to the public domain"),
    ("odbl-1.0", r"this (?:[^ ]+ ){1,6}is made available under the open database license"),
    ("odbl", r"any rights in individual contents of the database are licensed under the database contents license"),
    ("odc-by", r"this (?:[^ ]+ ){1,6}is made available under the open data commons attribution license"),
    ("pddl", r"this (?:[^ ]+ ){1,6}is made available under the public domain dedication and license"),
    ("unlicense", r"in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest"),
    ("unlicense", r"we make this dedication for the benefit of the public at large and to the detriment of our heirs and successors"),
    ("public-domain", r"this file (?:was|is) (?:written|put|placed) (?:by )?(?:[^ ]+ ){0,6}in the public domain"),
    ("public-domain", r"no copyright is claimed (?:and|in) (?:[^ ]+ ){0,8}(?:united states|public domain)"),
    ("public-domain", r"works? of the united states government (?:is|are) (?:not subject to copyright|in the public domain)"),
    # Source available and proprietary
    ("busl-1.1", r"effective on the change date or the fourth anniversary of the first publicly available distribution"),
    ("busl-1.1", r"use limitation means that production use"),
    ("busl-1.1", r"you may make production use of the licensed work provided"),
    ("sspl-1.0", r"service source code means the corresponding source for the program or the modified version"),
    ("elastic-2.0", r"you may not provide the software to third parties as a hosted or managed service"),
    ("elastic-2.0", r"you may not move change disable or circumvent the license key functionality in the software"),
    ("commons-clause", r"the grant of rights under the license will not include and the license does not grant to you the right to sell the software"),
    ("polyform-noncommercial", r"any noncommercial purpose is a permitted purpose"),
    ("polyform-shield", r"any purpose is a permitted purpose except for providing any product that competes with the software"),
    ("confluent-community", r"excluded purpose (?:means|is) making available any software as a service"),
    ("timescale", r"you are prohibited from (?:[^ ]+ ){1,10}database as a service"),
    ("proprietary", r"this software is the (?:confidential|proprietary|trade secret) (?:and proprietary )?(?:information|property) of"),
    ("proprietary", r"you shall not disclose such confidential information and shall use it only in accordance with the terms of the license agreement"),
    ("proprietary", r"no part of this (?:publication|document|software|work) may be (?:reproduced|copied|transmitted)"),
    ("proprietary", r"(?:you|licensee) (?:may|shall) not (?:[^ ]+ ){0,6}reverse engineer decompile or disassemble"),
    ("proprietary", r"this (?:software|product|program) is licensed not sold"),
    ("proprietary", r"use duplication or disclosure by the (?:u s )?government is subject to restrictions"),
    ("proprietary", r"by (?:installing|downloading|using) (?:or using )?(?:this|the) software you agree to be bound by"),
    ("proprietary", r"for evaluation purposes only and may not be used in production"),
    ("cla", r"you hereby grant to (?:[^ ]+ ){1,12}and to recipients of software distributed by"),
    ("dco", r"the contribution was created in whole or in part by me and i have the right to submit it"),
    ("llama", r"if on the (?:[^ ]+ ){1,6}version release date the monthly active users"),
    ("openrail", r"use based restrictions as referenced in paragraph 5 must be included"),
    ("openrail", r"you agree not to use the model or derivatives of the model"),
]
