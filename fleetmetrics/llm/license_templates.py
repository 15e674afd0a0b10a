"""Wording of public licenses in template markup, and the phrases that name them."""

from __future__ import annotations

from .licenses import Template

# The phrases whose places count as base.
BASE = [
    Template("mit", "under the mit license", base=True),
    Template("apache-2", "apache license version 2", base=True),
    Template("cc-by-nc", "cc by nc", base=True),
]

# The wording of the licenses' notices, as their publishers give it.
NOTICES = [
    Template(
        "mit",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software'
        ' <<beginOptional>>and associated documentation files<<endOptional>>'
        ' <<beginOptional>>(the <<var;name="what";original="Software";match=".{1,3}">>)<<endOptional>>, to deal in'
        ' <<var;name="which";original="the Software";match=".{1,4}">> without restriction, including without limitation'
        ' the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of'
        ' <<var;name="which";original="the Software";match=".{1,4}">>, and to permit persons to whom'
        ' <<var;name="which";original="the Software";match=".{1,4}">> is furnished to do so, subject to the following'
        ' conditions: The above copyright notice and this permission notice'
        ' <<beginOptional>>(including the next paragraph)<<endOptional>> shall be included in all copies or substantial'
        ' portions of <<var;name="which";original="the Software";match=".{1,4}">>.'
        ' <<beginOptional>>THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING'
        ' BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'
        '<<endOptional>>',
    ),
    Template(
        "isc",
        'Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose'
        ' with or without fee is hereby granted, provided that the above copyright notice and this permission notice'
        ' appear in all copies',
    ),
    Template(
        "bsd-2-clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the'
        ' following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the'
        ' above copyright notice, this list of conditions and the following disclaimer.'
        ' <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this'
        ' list of conditions and the following disclaimer in the documentation and/or other materials provided with the'
        ' distribution.',
    ),
    Template(
        "bsd-3-clause",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the'
        ' following conditions are met: <<beginOptional>>1<<endOptional>> Redistributions of source code must retain the'
        ' above copyright notice, this list of conditions and the following disclaimer.'
        ' <<beginOptional>>2<<endOptional>> Redistributions in binary form must reproduce the above copyright notice, this'
        ' list of conditions and the following disclaimer in the documentation and/or other materials provided with the'
        ' distribution. <<beginOptional>>3<<endOptional>> Neither the name of'
        ' <<var;name="organization";original="the copyright holder";match=".{1,20}">> nor the names of its contributors may'
        ' be used to endorse or promote products derived from this software without specific prior written permission',
    ),
    Template(
        "apache-2",
        'Licensed under the Apache License, Version 2.0 <<beginOptional>>(the "License")<<endOptional>>; you may not use'
        ' <<var;name="what";original="this file";match=".{1,4}">> except in compliance with the License. You may obtain a'
        ' copy of the License at',
    ),
    Template(
        "gpl-2",
        '<<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public'
        ' License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>'
        ' <<beginOptional>>either<<endOptional>> version 2',
    ),
    Template(
        "gpl-3",
        '<<beginOptional>>licensed<<endOptional>> under the <<beginOptional>>terms of the<<endOptional>> GNU General Public'
        ' License <<beginOptional>>as published by the Free Software Foundation<<endOptional>>'
        ' <<beginOptional>>either<<endOptional>> version 3',
    ),
    Template(
        "lgpl",
        'under the <<beginOptional>>terms of the<<endOptional>> GNU <<var;name="kind";original="Lesser";match="lesser|library">>'
        ' General Public License',
    ),
    Template(
        "agpl-3",
        'under the <<beginOptional>>terms of the<<endOptional>> GNU Affero General Public License'
        ' <<beginOptional>>as published by the Free Software Foundation<<endOptional>>'
        ' <<beginOptional>>either<<endOptional>> version 3',
    ),
    Template(
        "mpl-2",
        'subject to the terms of the Mozilla Public License, <<var;name="word";original="v.";match="v|version">> 2.0',
    ),
    Template(
        "cc-by",
        'licensed under <<beginOptional>>a<<endOptional>> <<beginOptional>>the<<endOptional>> Creative Commons Attribution'
        ' <<var;name="version";original="4.0";match="1 0|2 0|2 5|3 0|4 0">> <<var;name="port";original="International";match=".{0,2}">>'
        ' License',
    ),
    Template(
        "unlicense",
        'This is free and unencumbered software released into the public domain',
    ),
]

TEMPLATES = BASE + NOTICES
