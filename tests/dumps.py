"""Hand-written dumps holding one case per trap of the formats."""

import gzip

ARTISTS = """<?xml version="1.0" encoding="UTF-8"?>
<artists>
<artist><id>1</id><name>Ann Lee</name><realname>Ann L. Lee</realname><profile>First line,
second line of [l=North Road]</profile><aliases><name id="999">Lee A</name><name>nobody</name></aliases></artist>
<artist><id>2</id><name>The Band</name><realname>ignored</realname><profile/><members><name id="1">Ann Lee</name><name id="777">Gone</name></members></artist>
<artist><id>3</id><name>Empty Group</name><members/></artist>
<artist><name>No Id</name></artist>
<artist><id>5</id><profile>no name at all</profile></artist>
<artist><id>6</id><name/></artist>
<artist><id>999</id><name>Lee A</name><aliases><name id="1">Ann Lee</name><name id="1000">L.A.</name></aliases></artist>
<artist><id>1000</id><name>Ünïcödé "quoted", with comma</name><aliases><name id="999">Lee A</name><name id="1000">self</name></aliases></artist>
<artist><id>8</id><name>Bad Alias</name><aliases><name id="1">Ann Lee</name><name id="x9">what</name></aliases></artist>
<artist><id>9</id><name>Bad Member</name><members><name id="1">Ann Lee</name><name>unnamed</name></members></artist>
<artist><id>10</id><name>Trailing </name><aliases><name id="4444">no record</name></aliases></artist>
</artists>
"""

LABELS = """<?xml version="1.0" encoding="UTF-8"?>
<labels>
<label><id>1</id><name>North Road</name><profile>A label</profile><sublabels><label id="2">North Road Small</label><label id="3">Only Nested</label><label/></sublabels></label>
<label><id>2</id><name>North Road Minor</name><profile>Minor, but with a profile</profile></label>
<label><id>4</id><profile>nameless</profile></label>
<label><name>No Id Label</name><sublabels><label id="5">Lost</label></sublabels></label>
</labels>
"""

MASTERS = """<?xml version="1.0" encoding="UTF-8"?>
<masters>
<master id="1"><main_release>100</main_release></master>
<master id="2"><main_release>100</main_release></master>
<master id="3"><main_release>101</main_release></master>
<master id="4"></master>
<master id="5"><main_release/></master>
<master id="6"><main_release>abc</main_release></master>
<master id="7"><main_release>404</main_release></master>
<master id="8"><main_release>102</main_release></master>
<master id="9"><main_release>103</main_release></master>
<master id="10"><main_release>105</main_release></master>
</masters>
"""

RELEASES = """<?xml version="1.0" encoding="UTF-8"?>
<releases>
<release id="100" status="Accepted"><title>First</title><released>1995-08-07</released><artists><artist><id>1</id><name>Ann Lee</name></artist><artist><id>194</id></artist></artists><extraartists><artist><id>1</id></artist><artist><id>2</id></artist><artist><id>355</id></artist><artist><name>no id</name></artist></extraartists><labels><label id="1" name="North Road" catno="A1"/><label id="1" name="North Road" catno="A2"/><label name="no id"/></labels></release>
<release id="101"><title/><released>1964</released><artists><artist><id>8888</id></artist></artists><labels><label id="2" name=""/><label id="6" name="Only Listed"/></labels></release>
<release id="102"><released>1970</released><artists><artist><id>1</id></artist></artists><labels><label id="1" name="Never Seen"/></labels></release>
<release id="103"><title>Old Copy</title><artists><artist><id>3</id></artist></artists></release>
<release id="104"><title>Not Wanted</title><artists><artist><id>1</id></artist></artists><labels><label id="1" name="Not Wanted Either"/></labels></release>
<release id="103"><title>New Copy</title><artists><artist><id>5</id></artist></artists></release>
<release id="abc"><title>Bad Id</title></release>
<release id="105"><title>Credits of &lt;nobody&gt; &amp; co</title></release>
</releases>
"""


def write(folder, compress=True):
    """Write the four dumps and return their paths by plural name."""
    paths = {}
    for name, text in (("artists", ARTISTS), ("labels", LABELS), ("masters", MASTERS), ("releases", RELEASES)):
        path = f"{folder}/catalogue_20260801_{name}.xml" + (".gz" if compress else "")
        opened = gzip.open(path, "wt", encoding="utf-8") if compress else open(path, "w", encoding="utf-8")
        with opened as file:
            file.write(text)
        paths[name] = path
    return paths
