"""Programs of our own with the facts, routes and links that they must give, worked out by hand.

Each case is a repository of its own: name -> files (path -> text). Expected rows stand beside the programs they are of.
"""

from __future__ import annotations

#: Value flows to deserializers: (line, disposition, conditions that hold there).
ROUTES = {
    "ledger": ("""
$note = $_POST['note'];
$ledger = ['head' => $note, 'tail' => 'none'];
$note = date('c');
unserialize($note);
unserialize($ledger['head']);
unserialize($ledger['tail']);
unserialize($ledger[$where]);
""", [(5, "no_modeled_source", ""), (6, "proven_route", ""), (7, "no_modeled_source", ""), (8, "proven_route", "")]),
    "courier": ("""
$parcel = 'empty';
$label = &$parcel;
$label = $_COOKIE['label'];
unserialize($parcel);
unset($label);
$label = 'fresh';
unserialize($parcel);
$parcel = 'fresh';
unserialize($parcel);
""", [(5, "proven_route", ""), (8, "proven_route", ""), (10, "no_modeled_source", "")]),
    "depot": ("""
function fill(&$slot, $value) { $slot = $value; }
function keep($slot, $value) { $slot = $value; }
$a = 'x'; $b = 'x';
fill($a, $_GET['v']);
keep($b, $_GET['v']);
unserialize($a);
unserialize($b);
""", [(7, "proven_route", ""), (8, "no_modeled_source", "")]),
    "warehouse": ("""
function receive() { global $crate; $crate = $_REQUEST['crate']; }
function ship() { global $crate; unserialize($crate); }
function weigh() { $crate = 'local'; unserialize($crate); }
function audit() { unserialize($GLOBALS['crate']); }
""", [(3, "proven_route", ""), (4, "no_modeled_source", ""), (5, "proven_route", "")]),
    "boxes": ("""
class Box {
    public $inside;
    function open() { return unserialize($this->inside); }
    function shut() { return unserialize($this->lid); }
}
$box = new Box();
$box->inside = $_POST['b'];
$box->open();
""", [(4, "proven_route", ""), (5, "no_modeled_source", "")]),
    "requests": ("""
use Illuminate\\Http\\Request;
function store(Request $r) { return unserialize($r->input('cart')); }
function other(Thing $r) { return unserialize($r->input('cart')); }
""", [(3, "modeled_framework_request", ""), (4, "no_modeled_source", "")]),
    "uploads": ("""
$in = fopen('php://input', 'r');
$body = stream_get_contents($in);
unserialize($body);
$log = fopen('app.log', 'r');
unserialize(fgets($log));
unserialize($_FILES['doc']['name']);
unserialize(file_get_contents($_FILES['doc']['tmp_name']));
""", [(4, "proven_route", ""), (6, "no_modeled_source", ""), (7, "proven_route", ""), (8, "no_modeled_source", "")]),
    "filters": ("""
$n = filter_var($_GET['n'], FILTER_VALIDATE_INT);
unserialize($n);
unserialize(filter_var($_GET['n']));
if (ctype_digit($k = $_GET['k'])) {
    unserialize($k);
} else {
    unserialize($k);
}
""", [(3, "no_modeled_source", ""), (4, "conditional_route", ""), (6, "no_modeled_source", "ctype_digit($k = $_GET['k'])"), (8, "proven_route", "!(ctype_digit($k = $_GET['k']))")]),
    "options": ("""
$opts = ['allowed_classes' => false];
unserialize($_POST['a'], $opts);
$opts['allowed_classes'] = true;
unserialize($_POST['a'], $opts);
unserialize(options: ['max_depth' => 2], data: $_POST['a']);
unserialize(options: ['allowed_classes' => []], data: $_POST['a']);
""", [(3, "restricted_options", ""), (5, "proven_route", ""), (6, "proven_route", ""), (7, "restricted_options", "")]),
    "versions": ("""
$v = $_GET['v'];
if (version_compare(PHP_VERSION, '8.0', '<')) { unserialize($v); } else { $v = 'new'; }
unserialize($v);
if (PHP_VERSION_ID >= 70400) { $v = $_GET['w']; }
unserialize($v);
$v = 80100 > PHP_VERSION_ID ? $_GET['w'] : 'new';
unserialize($v);
""", [(4, "no_modeled_source", ""), (6, "proven_route", ""), (8, "no_modeled_source", "")]),
    "shadow": ("""
namespace Shop;
function unserialize($x) { return json_decode($x); }
unserialize($_GET['a']);
\\unserialize($_GET['a']);
""", [(5, "proven_route", "")]),
    "callbacks": ("""
array_map('unserialize', $_COOKIE);
call_user_func('unserialize', $_GET['x']);
call_user_func(function ($v) { return $v; }, $_GET['x']);
class Feed { static function read($v) { return unserialize($v); } }
call_user_func_array(['Feed', 'read'], [$_GET['y']]);
""", [(2, "proven_route", ""), (3, "proven_route", ""), (5, "proven_route", "")]),
    "holds": ("""
$t = $_GET['t'];
if (!is_string($t)) { exit; }
unserialize($t);
$t = $_GET['u'];
unserialize($t);
""", [(4, "proven_route", "!(!is_string($t))"), (6, "proven_route", "")]),
    "loops": ("""
$a = 'x'; $b = 'x'; $c = 'x';
for ($i = 0; $i < 9; $i++) {
    unserialize($c);
    $c = $b; $b = $a; $a = $_GET['s' . $i];
}
foreach ($_POST as $key => &$item) { $item = trim($item); unserialize($item); }
do { $last = 'x'; if ($stop) { break; } $last = $_GET['z']; } while ($more);
unserialize($last);
""", [(4, "proven_route", ""), (7, "proven_route", ""), (9, "proven_route", "")]),
    "capture": ("""
$seen = 'none'; $kept = 'none';
$collect = function () use (&$seen, $kept) { $seen = $_GET['q']; $kept = $_GET['q']; };
unserialize($seen);
unserialize($kept);
""", [(4, "proven_route", ""), (5, "no_modeled_source", "")]),
    "finals": ("""
function load() { try { $x = $_GET['x']; return $x; } finally { log_it(); } }
function gone() { try { return $_GET['x']; } finally { return 'c'; } }
unserialize(load());
function never($x) { throw new Error('no'); unserialize($x); }
never($_GET['x']);
""", [(4, "proven_route", "")]),
    "broken": ("""
function ok() { return unserialize($_GET['a']); }
function bad( { return 1;
""", [(2, "proven_route", "")]),
}
ROUTES = {k: ("<?php" + t, rows) for k, (t, rows) in ROUTES.items()}

#: Code read as a library: (line, disposition).
LIBRARY = ("""<?php
class Shelf {
    public function put($blob) { return unserialize($blob); }
    private function hide($blob) { return unserialize($blob); }
    public function pass($blob) { return $this->hide('c'); }
    public function __construct($first) { $this->first = $first; }
    private function late() { return unserialize($this->first); }
    private function __clone() { return unserialize($this->second); }
}
""", [(3, "conditional_library_api"), (4, "no_modeled_source"), (7, "conditional_library_api"), (8, "no_modeled_source")])

#: Paths that may name an archive: (line, disposition before 8.0, from 8.0 on).
ARCHIVES = ("""<?php
$root = 'img/';
file_exists($root . $_GET['f']);
is_file($_GET['f']);
is_dir('phar://pack.phar');
filesize($unknown);
copy('a.txt', $_POST['to']);
""", [(3, "fixed_path", "fixed_path"), (4, "proven_route", "proven_route"), (5, "fixed_archive_path", "inactive_for_version"), (6, "no_modeled_source", "inactive_for_version"), (7, "fixed_path", "fixed_path"), (7, "proven_route", "proven_route")])

#: A class library with restored objects: links of the call graph, chains, sites.
GADGETS = {"src/gadgets.php": """<?php
namespace Depot;
abstract class Base { protected $next; function __destruct() { $this->close(); } function close() {} }
class Door extends Base { private Lock $lock; function close() { $this->lock->turn($this->key); } }
class Lock { function turn($k) { $this->drop($k); } function __call($n, $a) { unlink($a[0]); } }
class Sprung extends Lock { function turn($k) { eval($k); } }
class Note { private $body; function __toString() { return file_get_contents($this->body); } }
class Page { private Note $note; private $cb; function __wakeup() { return 'p' . $this->note; } function run() { call_user_func($this->cb, 1); } }
class Still { function __unserialize(array $d) { $this->d = $d; } }
""", "src/use.php": """<?php
namespace Depot;
unserialize($a, ['allowed_classes' => ['Depot\\Door', Page::class]]);
unserialize($b, ['allowed_classes' => false]);
"""}
EDGES = [
    ("depot\\base::__destruct", "depot\\base::close", "direct", 1.0), ("depot\\base::__destruct", "depot\\door::close", "override", 0.55), ("depot\\door::close", "depot\\lock::turn", "typed_many", 0.7), ("depot\\door::close", "depot\\sprung::turn", "typed_many", 0.7),
    ("depot\\lock::turn", "depot\\lock::__call", "magic_call", 0.9), ("depot\\lock::__call", "SINK::unlink", "sink", 1.0), ("depot\\sprung::turn", "SINK::eval", "sink", 1.0), ("depot\\note::__tostring", "SINK::file_get_contents", "sink", 1.0),
    ("depot\\page::__wakeup", "depot\\note::__tostring", "magic_tostring", 0.9), ("depot\\page::run", "SINK::call_user_func", "sink", 1.0),
]
#: (entry, sink, length, level, properties)
CHAINS = [
    ("depot\\door::__destruct", "SINK::unlink", 5, "LOW", ["key", "lock"]), ("depot\\door::__destruct", "SINK::eval", 4, "LOW", ["key", "lock"]), ("depot\\page::__wakeup", "SINK::file_get_contents", 3, "HIGH", ["body", "note"]),
]
#: (line, policy, classes)
SITES = [(3, "allowlist", "depot\\door,page"), (4, "deny", "")]

#: Files that include each other: entry points, sessions, constants.
WEB = {"index.php": "<?php define('APP', 1); session_start(); require __DIR__ . '/lib/core.php';", "cron.php": "<?php require 'lib/core.php'; if ($x) { session_start(); }", "lib/core.php": "<?php defined('APP') or exit; include 'lib/tools.php';", "lib/tools.php": "<?php if (!defined('APP')) { return; } $a = 1;", "lib/alone.php": "<?php defined('OTHER') || die('no'); include $plugin;"}
#: (path, entries, starting, status, included without a condition)
LOADING = [("index.php", 1, 1, "direct", None), ("cron.php", 1, 0, "direct", None), ("lib/core.php", 2, 1, "included", True), ("lib/tools.php", 2, 1, "unknown", True), ("lib/alone.php", 1, 0, "unknown", None)]

#: Control flow of one scope: (line, kind, reachable), dominators as (line, line), reaching writes as (line, variable, line or 0 for what came in).
FLOW = """<?php
function f($a) {
    $x = 1;
    if ($a) {
        $x = 2;
    } else {
        return 0;
    }
    while ($a) {
        $y = $x;
        if ($y) { break; }
        $x = 3;
    }
    throw new E($x);
    $z = 4;
}
"""
REACHED = [(3, "expr", True), (4, "if", True), (5, "expr", True), (7, "return", True), (9, "while", True), (10, "expr", True), (11, "if", True), (11, "break", True), (12, "expr", True), (14, "throw", True), (15, "expr", False)]
DOMINATED = [(3, 4), (3, 5), (3, 7), (3, 9), (3, 10), (3, 11), (3, 12), (3, 14), (4, 5), (4, 7), (4, 9), (4, 10), (4, 11), (4, 12), (4, 14), (5, 9), (5, 10), (5, 11), (5, 12), (5, 14), (9, 10), (9, 11), (9, 12), (9, 14), (10, 11), (10, 12), (11, 12)]
REACHING = [(14, "x", 5), (14, "x", 12), (10, "x", 5), (10, "x", 12), (4, "x", 3), (14, "y", 10), (14, "y", 0)]

#: Calls that rules and reviews look at.
REVIEWED = """<?php
unserialize($_POST['cart']);
unserialize(base64_decode(trim($raw) . pad($x)), ['allowed_classes' => true]);
class Cache { function __wakeup() { unlink($this->file); } function tidy() { unlink($this->file); } }
$p = new Phar('a.phar');
$p->getMetadata();
$s = new \\SplObjectStorage();
$s->unserialize($raw);
yaml_parse(yaml_parse($raw));
class Job { private $task; function __unserialize(array $d) { $this->task = $d['t']; } function go() { call_user_func($this->task); } }
"""
MATCHED = [
    ("loom.unserialize.open", 2), ("loom.unserialize.sent", 2), ("loom.unserialize.options", 3), ("loom.magic.sink", 4), ("loom.yaml", 9),
]
REVIEWS = [(6, "archive_metadata"), (8, "container_unserialize")]

#: Values that sessions and tables keep.
KEPT = """<?php
$got = unserialize($_COOKIE['c']); $_SESSION['cart'] = $got;
class Order { function ship() { $this->pack(); } function pack() { unlink($this->tmp); } }
class Basket { function ship() { return 1; } }
function later() { $_SESSION['cart']->ship(); $_SESSION['user']->ship(); $_SESSION['cart'] = new Basket(); $_SESSION['cart']->ship(); }
$db->query("SELECT id, t.body FROM notes WHERE id = 1");
$db->exec("INSERT INTO notes (body, made) VALUES (1, 2)");
"""
#: Routes of all kinds in KEPT.
ROUTE_KINDS = [
    ("source_to_sink", "proven", 2, ""), ("candidate_persistent_store", "conditional", 6, "write_read_identity_and_order,write_authorization"), ("candidate_session_dispatch", "conditional", 5, "session_identity_and_request_order,object_class_and_properties"),
]

#: A dispatch that only its framework knows: program, table, (class, method, note).
CONTRACTED = (
    """<?php
class Gate { private $box; function admit($in) { return $this->box->unseal($in); } function other($in) { return $this->box->unseal($in); } }
class Seal { function unseal($in) { return unserialize($in); } }
class Missing { }
""",
    [("Gate", "admit", "$this->box", "unseal", "Seal", "the container picks the class"), ("Gate", "admit", "$this->box", "unseal", "Missing", "not there")],
    [("seal", "unseal", "the container picks the class")],
)

#: Levels of evidence: program, (line, level, limitations, detection, completeness).
ASSESSED = ("""<?php
unserialize($_GET['a']);
unserialize(wash($_GET['a']));
if (is_string($_GET['b']) && $ok) { unserialize($ok . $_GET['b']); }
function api($blob) { unserialize($blob); }
$rows = $wpdb->get_results('SELECT a FROM b');
unserialize($rows[0]);
unserialize($_GET['a'], ['allowed_classes' => false]);
""", [
    (2, "observed_source_flow", "", "direct_untrusted_deserialization", "within_model"), (3, "unresolved_flow", "unresolved_propagation", "conditional_path", "limited"), (4, "observed_source_flow", "guard_not_proven", "conditional_path", "limited"),
    (5, "assumed_api_flow", "external_caller_assumed", "conditional_path", "limited"), (7, "assumed_persistent_flow", "persistent_write_unverified", "conditional_path", "limited"),
])

#: Includes of WEB: (path, target, from the file's own folder, whether the target is there).
INCLUDED = [("index.php", "lib/core.php", True, True), ("cron.php", "lib/core.php", False, True), ("lib/core.php", "lib/tools.php", False, True), ("lib/alone.php", None, False, False)]

#: Declarations: program, (kind, name, detail).
DECLARED = ("""<?php
namespace Acme\\Mail;
use Acme\\Core\\Model as Base;
use function Acme\\fmt;
interface Sends {}
abstract class Letter extends Base implements Sends {
    use Stamps;
    protected ?int $weight = 0;
    public static $count;
    function __construct(private string $to) {}
    abstract function send(int $n, ...$rest): bool;
}
function post() { return function () { return 1; }; }
""", [
    ("interface", "Acme\\Mail\\Sends", ""), ("class", "Acme\\Mail\\Letter", "Acme\\Core\\Model|Acme\\Mail\\Sends|Acme\\Mail\\Stamps"), ("property", "weight", "protected ?int"), ("property", "count", "public "), ("property", "to", "private string"),
    ("method", "__construct", "public 1"), ("method", "send", "public 2"), ("function", "Acme\\Mail\\post", "public 0"), ("closure", "", "public 0"), ("import", "Acme\\Core\\Model", "class Base"), ("import", "Acme\\fmt", "function fmt"),
])

#: Calls of the case "callbacks": (line, how, callee, callback, conditional).
CALLED = [
    (2, "function", "array_map", "literal", False), (2, "function", "unserialize", None, False), (3, "function", "call_user_func", "literal", False), (3, "function", "unserialize", None, False),
    (4, "function", "call_user_func", "closure", False), (5, "function", "unserialize", None, True), (6, "function", "call_user_func_array", "literal", False), (6, "static", "read", None, False),
]
#: Chains of GADGETS as text, and links from each of its methods to the nearest sink.
OUTLINES = [
    "depot\\base::__destruct\n  depot\\door::close\n    depot\\lock::turn\n      depot\\lock::__call\n        unlink", "depot\\base::__destruct\n  depot\\door::close\n    depot\\sprung::turn\n      eval",
    "depot\\page::__wakeup\n  depot\\note::__tostring\n    file_get_contents",
]
DISTANCES = [
    ("SINK::eval", 0), ("SINK::unlink", 0), ("SINK::file_get_contents", 0), ("SINK::call_user_func", 0), ("depot\\sprung::turn", 1), ("depot\\lock::__call", 1), ("depot\\note::__tostring", 1), ("depot\\page::run", 1),
    ("depot\\lock::turn", 2), ("depot\\door::close", 2), ("depot\\page::__wakeup", 2), ("depot\\base::__destruct", 3),
]
