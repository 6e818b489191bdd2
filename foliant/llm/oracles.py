"""DuckDB SQL of the operators that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

JACCARD = f"""
WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM w),
e AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM s),
links AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e AS a JOIN e AS b ON a.x = b.x AND a.doc_id <> b.doc_id AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n) GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
reach AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT l.b, r.root FROM reach AS r JOIN links AS l ON r.doc_id = l.a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, (SELECT min(root) FROM reach AS r WHERE r.doc_id = s.doc_id) AS component_id FROM s
"""


#: The canonical form in SQL's own terms; the digests below are written out, so that a change of the operator's tables or expressions shows.
_CANONICAL = r"""nullif(trim(regexp_replace(translate(regexp_replace(replace(replace(replace(replace(replace(replace(lower({x}),
'licence', 'license'), 'sub-license', 'sublicense'), 'non-infringement', 'noninfringement'), 'merchantibility', 'merchantability'), 'acknowledgement', 'acknowledgment'), 'http://', 'https://'),
'(?m)^[^\S\n]*(?:copyright[^\S\n]*(?:\(c\)|©|[0-9]{{4}})|\(c\)|©)[^\n]*$|^[^\S\n]*all rights reserved\.?[^\S\n]*$', '', 'g'),
'!"#$%&''()*+,-./:;<=>?@[\]^_`{{|}}~‘’“”–—•' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), repeat(' ', 44)), ' {{2,}}', ' ', 'g')), '')"""
_KNOWN = """('25a274d52b3014d9bd64e0f3362fd279ac1655f163d5c518f6b9f6c43354802c', '0BSD'),
('08fe576fe0b58cdba2ce74db4b4a03861f339a8abec5e910aff7657b0e4ec33b', 'Apache-2.0'),
('28de6b6f31af692f3276f4c7d7f809bc7d39d3206a71fe090d61d943447aabc6', 'Apache-2.0'),
('c40235f98e8998f2e4f5fc5131b16fb3c6c5f8ce252d3e6e08daf233725c2073', 'Apache-2.0'),
('cc31b92fc0ea6895531537118f604200d6560f6fd6e2394146ed1707168cc0cc', 'Apache-2.0'),
('e963bc30f4d3c45f45030c34409ee37315564625649c1394e32bb5ddd99e01b2', 'Artistic-1.0-Perl'),
('a56fee4b2f66331ed54da4950ef9c9391453fd1490b4d8ea202bc29683bcbd30', 'BSD-2-Clause'),
('9b83d3dee0616d07b82a272dd9bf5134a9f402b750f5ee6188458073b0a32ff2', 'BSD-3-Clause'),
('4242941f56cc0aaf7a416006734167273b17a074704308b941e02a99526671b6', 'BSL-1.0'),
('5aee400278b51606c2353a854f7d936ffffe555bf9c67e56d5db376a76b63bb2', 'CC-BY-4.0'),
('e34399ae0e957e9bb9b4a0e3f615d05722861801f4e0718f35cefc762c349a16', 'CC-BY-NC-4.0'),
('96bdc7f63190fb4bd1ae584b890300ed7517d858b34c945642a3b9b2f1612a5f', 'CC0-1.0'),
('1c057ea35084eb195331cec1a49fca335c176422a7726a9a23636906fd4e241f', 'GFDL-1.2'),
('7e8edd3abe6258bb82bb853d91a0c24fcd9976894fd0592747354cffe1cb18e7', 'GFDL-1.3'),
('8f586b09c093668e2db772bdcfc1d5dc0b03e0e862fccbff035e1bf134e9b224', 'GPL-1.0'),
('e1270b653c300290e7c039142bccb8776f9b5d14e8a05bc4e87dc7d1614a3b34', 'GPL-2.0'),
('efe73660e5476cf0368fc0fc143f624ff9d1b73c4484b14a9969dd20c5786821', 'GPL-2.0'),
('37d45dc3b9135ed58bd277e14112dfea95629cda77a8d62cdb6bcd862e7b5bf5', 'GPL-3.0'),
('66237b20dfaa335f5c003a3da64555538643deb65ca015c0d5fa588527312c4e', 'GPL-3.0'),
('a8cd54d6683aa630f0b8d05d56184ad91dc486756da2df61c94d3e4e8d5ecb68', 'GPL-3.0'),
('ac6b52d57c0104e687039148f7b8e370e04c9bb5705bb786f8ef814eb65e8636', 'GPL-3.0'),
('217da0747cec63a2e734185db11cbaa819bcd9e5b83cd12f812128fffe66e26a', 'ISC'),
('f172f90a892d869d5d840d5f4363218a9b21bdb1bd3925ba9c752d1660134fee', 'ISC'),
('61af4dcea4e412e8ccfb8877fd2762bd6d962f8d42a9fa2c06cf7b4613f2c908', 'LGPL-2.0'),
('48d2010e70a815a564f914b0c7c1e80d7a6843793348fed3684c957112fe0aa4', 'LGPL-2.1'),
('4d55922bdeafabde164d75448bbfb0b474bf952bbb541325364010900acd9891', 'LGPL-2.1'),
('aae2b222477171fb64e298e7965e768a9a6f85320646b266c94399ac029d42be', 'LGPL-3.0'),
('00217f00b903e5911b513ea1f36a2aeb7b8999ee6622cd67b2e675f98285e541', 'MIT'),
('0cf21bdfd1964a97a8615e128534845826afbc887edc95aa5c925cbf64386b5c', 'MIT'),
('123a3b9fdc300d1b6f077f74b288de15d7f2c5b0b3b11e89fd799b48bfad5940', 'MIT'),
('35a446201226de6b27cfb7106d0f6c697f63bfeac2913dcf89024911e66ef164', 'MIT'),
('6ad3654379e72bbdf8478d5c90fb1e2525aba033fbe675e0ef2248aac67c0f6f', 'MIT'),
('6c833965e9ca4cf8095655005226f24fe8bf7b1605dbe513204837a7371fa127', 'MIT'),
('a181c333030f65ebcf2eabeca3493225b6b03fce6907bdd3e59e7a8a37180fbd', 'MIT-0'),
('fbe9a0b96f52e03cb474f9a7083781399c011279e85b548118563ec96e659354', 'MPL-1.1'),
('3dacd2c104719e7227969cbdcc7d581518827199e830b9379627eec0a32f8ab7', 'MPL-2.0'),
('c933e7afa5abf4f2ac1fe841a7716f9501b9882b5a4565611f8e066d58c9470c', 'Unlicense'),
('fd1b07be5f4f94926b6ea4df3943b05ab90c1a1f3b1a3d574ae7ab58bca58fff', 'Unlicense'),
('5757ac9cdd42713ed24f9dc174585ad1f3d214a70f8b5a6bc83ea39768bbe195', 'WTFPL'),
('1b8c5cd52eceb19ab0bc3cb40be110b1c0e7fa2671a3fe5866e59dd1502e69c7', 'Zlib')"""

LICENSES = f"""
WITH k(digest, license) AS (VALUES {_KNOWN}),
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents),
found AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list(license))), ',') AS notices FROM (SELECT doc_id, sha256({_CANONICAL.format(x="line")}) AS digest FROM lines) JOIN k USING (digest) GROUP BY doc_id)
SELECT doc_id, digest, license, coalesce(notices, '') AS notices FROM (SELECT doc_id, sha256({_CANONICAL.format(x="text")}) AS digest FROM documents) LEFT JOIN k USING (digest) LEFT JOIN found USING (doc_id)
"""

CALLS = """
WITH c AS (SELECT conv_id, turn, conv_id || ':' || turn AS call_id, role, text FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
r AS (SELECT conv_id, conv_id || ':' || (turn - 1) AS call_id, min(text) AS content FROM conversations WHERE role = 'assistant' GROUP BY ALL)
SELECT conv_id, call_id, CAST(turn > 0 AND EXISTS (SELECT 1 FROM c AS z WHERE z.conv_id = c.conv_id AND z.turn = 0) AS BIGINT) AS level, content IS NOT NULL AS linked,
CASE WHEN role IN ('user', 'system') THEN concat_ws(',', CASE WHEN length(text) > CASE role WHEN 'user' THEN 400 ELSE 100 END THEN 'size' END, CASE WHEN text = '' THEN 'text' END) ELSE '*' END AS broken,
sha256('{"arguments":{"size":' || length(text) || ',"text":' || to_json(text) || '},"id":"' || call_id || '","name":' || coalesce('"' || role || '"', 'null') || ',"result":' || coalesce(to_json(content), 'null') || '}') AS json_sha256
FROM c LEFT JOIN r USING (conv_id, call_id)
"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last FROM pages),
b AS (SELECT *, CAST(CAST(unhex(sha1(h)) AS BIT) AS VARCHAR) AS bits FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(CAST(substr(bits, i * 5 + 1, 5) AS BIT) AS INTEGER) + 1, 1)), '') AS payload_digest,
CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM b
"""

FILL_MIDDLE = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256('42:' || doc_id) AS h FROM documents),
d AS (SELECT *, len(u) AS n, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2, CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, array_to_string(u[1:a], '') AS prefix, array_to_string(u[a + 1:b], '') AS middle, array_to_string(u[b + 1:], '') AS suffix FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(prefix) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(middle) AS BIGINT) END AS middle_chars,
sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle ELSE '<S>' || suffix || '<P>' || prefix || '<M>' || middle END) AS output_sha256, sha256(text) AS restored_sha256 FROM p
"""

_FIELD = "CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
_LEAF = lambda n: "sha256(" + " || ".join(_FIELD.format(x=x) for x in ("doc_id", "source", "lang", n, "text")) + ")"
_UP = "list_transform(range(1, len({x}) + 1, 2), lambda i: sha256({x}[i] || coalesce({x}[i + 1], '')))"

#: Levels as lists of nodes; the check sum of an id is worked out bit by bit.
MERKLE = f"""
WITH RECURSIVE leaves AS (SELECT doc_id, lang, {_LEAF("n_chars")} AS leaf, {_LEAF("(n_chars + 1)")} AS changed, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i,
xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(1, length(CAST(doc_id AS VARCHAR)) + 1), lambda k: CAST(ascii(CAST(doc_id AS VARCHAR)[k]) AS BIGINT))),
lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END))) % 7 = 0 AS tampered FROM documents),
low AS (SELECT lang, 0 AS lvl, list(leaf ORDER BY doc_id) AS l FROM leaves GROUP BY lang UNION ALL SELECT lang, lvl + 1, {_UP.format(x="l")} FROM low WHERE len(l) > 1),
subroots AS (SELECT lang, l[1] AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS j FROM low WHERE len(l) = 1),
high AS (SELECT 0 AS lvl, list(subroot ORDER BY j) AS l FROM subroots UNION ALL SELECT lvl + 1, {_UP.format(x="l")} FROM high WHERE len(l) > 1),
step AS (SELECT d.doc_id, low.lvl AS lvl, (i >> low.lvl) % 2 = 1 AS is_right, l[xor(i >> low.lvl, 1) + 1] AS s FROM leaves AS d JOIN low ON low.lang IS NOT DISTINCT FROM d.lang AND len(l) > 1
UNION ALL SELECT d.doc_id, 1000 + high.lvl, (j >> high.lvl) % 2 = 1, l[xor(j >> high.lvl, 1) + 1] FROM leaves AS d JOIN subroots AS r ON r.lang IS NOT DISTINCT FROM d.lang, high WHERE len(l) > 1),
proof AS (SELECT doc_id, list({{'r': is_right, 's': s}} ORDER BY lvl) AS p, sha256(coalesce(string_agg(s, '' ORDER BY lvl), '')) AS proof_sha256 FROM step GROUP BY doc_id),
fold AS (SELECT doc_id, 0 AS k, CASE WHEN tampered THEN changed ELSE leaf END AS node FROM leaves
UNION ALL SELECT doc_id, k + 1, sha256(CASE WHEN p[k + 1].s IS NULL THEN node WHEN p[k + 1].r THEN p[k + 1].s || node ELSE node || p[k + 1].s END) FROM fold JOIN proof USING (doc_id) WHERE k < len(p)),
done AS (SELECT doc_id, max_by(node, k) AS folded_root FROM fold GROUP BY doc_id)
SELECT d.doc_id, leaf, subroot, (SELECT l[1] FROM high WHERE len(l) = 1) AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = (SELECT l[1] FROM high WHERE len(l) = 1) AS verified
FROM leaves AS d JOIN subroots AS r ON r.lang IS NOT DISTINCT FROM d.lang JOIN done USING (doc_id) LEFT JOIN proof USING (doc_id)
"""
