r"""Source files that queries generate from a driver table, one of each kind for every supplier.

``{k}`` stands for the supplier's key, so that the same text gives other names in every
file. Beside each text stands what is to be found in it, written down by hand.
"""

from __future__ import annotations

PYTHON = '''import os
import json as j{k}
from .util{k} import helper, other as o
from pkg.mod{k} import *

class Base{k}: pass

class Service{k}(Base{k}):
    @property
    def name(self):
        return helper(self.x)

    async def login(self):
        def inner():
            return o.run()[0].go{k}()
        return inner()

def start{k}():
    return Service{k}().login()

CONST = os.getcwd()
'''

TYPESCRIPT = '''import def{k}, { a as b, type T } from './mod{k}';
import * as ns from "pkg{k}";
export { x as y{k} } from '../re{k}';
export * from './all{k}';
let dir = './d{k}';
const lazy = require(dir + '/e');
const { p, q: r } = require(`${dir}/f`);
// import no from 'no';
export interface Repo{k} extends Other<User, Role> {
  area(): number;
}
export class Auth{k} extends Base implements Repo{k} {
  private users: Map<string, User>;
  @Input() label = "x(1)";
  static make = () => { return build{k}(); };
  abstract area(): number;
  async login(user: User): Promise<{ ok: boolean }> {
    if (user) { helper{k}(user); }
    this.repo?.find<User>(1).then(done);
    return { ok: true };
  }
}
export function helper{k}(u: User) { return ns.go(u); }
export default function () { return 1 }
'''

JAVASCRIPT = '''module.exports = View{k};
exports.normalize{k} = function (type) {
  return type;
};
app.use = function use{k}(fn) {
  return fn;
};
methods.forEach(function (method) {
  app[method] = function (path) {
    return go{k}(path);
  };
});
const count = 1, inline{k} = async (req) => req;
const handlers = {
  get{k}(req) { return req; },
  save: (req) => req,
  size: 1,
  nested: {
    ping{k}() { return true; }
  }
};
const { one, two: deux{k}, deep: { three }, list = () => true, ...rest } = controllers;
const [first{k}, , third] = handlers;
describe("x{k}", () => {
  it("y", async () => { await login(); });
});
(function () { boot{k}(); })();
const part = await import('./part{k}.js');
'''

TSX = '''import { Row{k} } from './row{k}';
export const List{k} = (props: Props) => {
  return <ul>{props.items.map((x) => <Row{k} key={key{k}(x)} />)}</ul>;
};
function key{k}(x: Item) { return x.id; }
'''

BASH = '''source ./lib{k}.sh
. ../shared/env{k}.sh
source "$DYNAMIC/no.sh"
build{k}() {
  compile one
}
function run{k} {
  build{k}
}
run{k}
'''

C = '''#include "audit{k}.h"
#include <stdio.h>
struct point{k} { int x; };
typedef struct { int a; } pair{k};
enum color { RED };
static int add{k}(int a, int b) {
  return a + b;
}
int main(void) { /* no(1) */ return add{k}(1, 2) + other{k}(3); }
'''

CPP = '''#include "shape{k}.hpp"
class Shape{k} : public Base {
 public:
  int area() const { return side{k}(); }
};
void draw{k}() {
  std::sort(a, b);
  item->show{k}();
}
'''

CSHARP = '''using System;
using static App.Tool{k};
using J{k} = App.Json;
namespace App.Core{k} {
  public class Svc{k} : Base<int>, IThing {
    public class Inner { public string Title { get; set; } }
    public List<User{k}> Users { get; set; }
    public Dictionary<string, Task<Role>> Roles { get; set; }
    public int Run{k}(string s) {
      var u = new User{k}();
      return u.Name(s).Trim();
    }
  }
  public static class Ext {
    public static int Twice{k}(this int n) { return n; }
  }
}
'''

GO = '''package main{k}
import (
  "fmt"
  log{k} "x.org/logging"
)
type Server{k} struct { n int }
type Store interface { Get() }
const (
  First{k} = 1
  Second = 2
)
var total{k} int
func (s *Server{k}) Run(a int) error { return s.stop{k}() }
func main() {
  fmt.Println("no(1)")
  helper{k}(1)
}
func helper{k}(n int) {}
'''

JAVA = '''package a.b{k};
import java.util.List;
import a.tools{k}.*;
import static a.Tool{k}.go;
public class Svc{k} extends Base<X> implements One, Two {
  private int count{k}, other;
  public Svc{k}(int n) { this.n = n; }
  public int size() {
    return names.size{k}().intValue();
  }
  interface Part { }
}
'''

PHP = '''<?php
namespace App{k};
use App\\\\Model\\\\{User{k}, Role as R};
use function App\\\\run{k};
class Svc{k} extends Base {
  const LIMIT{k} = 1;
  private $x{k} = 2;
  public function run($a) {
    return $this->go{k}(Tool::make($a));
  }
}
function top{k}() { return new Svc{k}(); }
'''.replace("\\\\", "\\")

RUBY = '''require 'json'
require_relative 'lib/my_tool{k}'
module App{k}
  class Svc < Base
    LIMIT{k} = 3
    def run(a)
      MyTool{k}.go(a)
    end
  end
end
'''.replace("LIMIT{k}", "LIMIT_{k}")

RUST = '''mod util{k};
use crate::a{k}::{b::C, d as e, self};
pub use super::x{k}::*;
pub struct P{k} { n: u32 }
pub trait Show { fn show(&self); }
impl Show for P{k} {
    fn show(&self) { self.n.help{k}(); }
}
const MAX_{k}: u32 = 1;
fn main() {
    util{k}::run(1);
    println!("no(1)");
    let p = P{k}::new().build();
}
'''

TEXTS = {
    "python": ("src/p{k}.py", PYTHON), "typescript": ("src/t{k}.ts", TYPESCRIPT), "javascript": ("src/j{k}.js", JAVASCRIPT), "tsx": ("src/x{k}.tsx", TSX), "bash": ("bin/b{k}.sh", BASH),
    "c": ("src/c{k}.c", C), "cpp": ("src/c{k}.cpp", CPP), "csharp": ("src/S{k}.cs", CSHARP), "go": ("cmd/g{k}.go", GO), "java": ("src/main/java/Svc{k}.java", JAVA), "php": ("src/p{k}.php", PHP),
    "ruby": ("lib/r{k}.rb", RUBY), "rust": ("src/r{k}.rs", RUST),
}

# What is in each text, a row a line: symbol, name, kind, line, last line; edge, target, kind, alias, imported name, line;
# call, callee, caller, line, and whether the file itself has the callee.
FOUND = {
    "python": r"""
symbol|Base{k}|class|-|-|6|6|-
symbol|Service{k}|class|-|-|8|16|-
symbol|Service{k}.name|method|-|-|9|11|-
symbol|Service{k}.login|method|-|-|13|16|-
symbol|Service{k}.inner|function|-|-|14|15|-
symbol|start{k}|function|-|-|18|19|-
edge|os|import|os|*|1|-|-
edge|json|import|j{k}|*|2|-|-
edge|.util{k}|import|-|-|3|-|-
edge|.util{k}.helper|import|helper|helper|3|-|-
edge|.util{k}.other|import|o|other|3|-|-
edge|pkg.mod{k}|import|-|-|4|-|-
edge|Base{k}|base_type|-|Service{k}|8|-|-
call|helper|Service{k}.name|-|-|11|-|open
call|o.run.go{k}|Service{k}.inner|-|-|15|-|open
call|o.run|Service{k}.inner|-|-|15|-|open
call|inner|Service{k}.login|-|-|16|-|own
call|Service{k}.login|start{k}|-|-|19|-|own
call|Service{k}|start{k}|-|-|19|-|open
call|os.getcwd|<module>|-|-|21|-|open
""",
    "typescript": r"""
symbol|dir|variable|-|-|5|5|-
symbol|lazy|variable|-|-|6|6|-
symbol|p|variable|-|-|7|7|-
symbol|r|variable|-|-|7|7|-
symbol|Repo{k}|interface|-|-|9|11|-
symbol|Auth{k}|class|-|-|12|22|-
symbol|Auth{k}.users|method|-|-|13|13|-
symbol|Auth{k}.label|method|-|-|14|14|-
symbol|Auth{k}.make|method|-|-|15|15|-
symbol|Auth{k}.login|method|-|-|17|21|-
symbol|helper{k}|function|-|-|23|23|-
symbol|default|function|-|-|24|24|-
edge|./mod{k}|import|-|-|1|-|-
edge|./mod{k}|import_alias|def{k}|default|1|-|-
edge|./mod{k}|import_alias|b|a|1|-|-
edge|./mod{k}|import_alias|T|T|1|-|-
edge|pkg{k}|import|-|-|2|-|-
edge|pkg{k}|import_namespace|ns|*|2|-|-
edge|../re{k}|import|-|-|3|-|-
edge|../re{k}|export_alias|y{k}|x|3|-|-
edge|./all{k}|import|-|-|4|-|-
edge|./all{k}|export_namespace|-|*|4|-|-
edge|./d{k}/e|require|-|-|6|-|-
edge|./d{k}/e|import_namespace|lazy|*|6|-|-
edge|./d{k}/f|require|-|-|7|-|-
edge|./d{k}/f|import_alias|p|p|7|-|-
edge|./d{k}/f|import_alias|r|q|7|-|-
edge|Other|base_type|-|Repo{k}|9|-|-
edge|Base|base_type|-|Auth{k}|12|-|-
edge|Repo{k}|base_type|-|Auth{k}|12|-|-
call|build{k}|Auth{k}.make|-|-|15|-|open
call|helper{k}|Auth{k}.login|-|-|18|-|open
call|this.repo.find|Auth{k}.login|-|-|19|-|open
call|this.repo.find.then|Auth{k}.login|-|-|19|-|open
call|ns.go|helper{k}|-|-|23|-|open
""",
    "javascript": r"""
symbol|View{k}|variable|-|-|1|1|-
symbol|exports.normalize{k}|method|-|-|2|4|-
symbol|app.use|method|-|-|5|7|-
symbol|use{k}|function|-|-|5|7|-
symbol|app.<dynamic>|method|-|-|9|11|-
symbol|count|variable|-|-|13|13|-
symbol|inline{k}|function|-|-|13|13|-
symbol|handlers|function|-|-|14|21|-
symbol|handlers.get{k}|method|-|-|15|15|-
symbol|handlers.save|method|-|-|16|16|-
symbol|handlers.nested.ping{k}|method|-|-|19|19|-
symbol|one|variable|-|-|22|22|-
symbol|deux{k}|variable|-|-|22|22|-
symbol|three|variable|-|-|22|22|-
symbol|list|function|-|-|22|22|-
symbol|rest|variable|-|-|22|22|-
symbol|first{k}|variable|-|-|23|23|-
symbol|third|variable|-|-|23|23|-
symbol|part|variable|-|-|28|28|-
edge|./part{k}.js|import|-|-|28|-|-
edge|./part{k}.js|import_namespace|part|*|28|-|-
call|methods.forEach|<module>|-|-|8|-|open
call|go{k}|methods.forEach.<callback>|-|-|10|-|open
call|describe|<module>|-|-|24|-|open
call|it|describe.<callback>|-|-|25|-|open
call|login|it.<callback>|-|-|25|-|open
call|boot{k}|<module>|-|-|27|-|open
""",
    "tsx": r"""
symbol|List{k}|function|-|-|2|4|-
symbol|key{k}|function|-|-|5|5|-
edge|./row{k}|import|-|-|1|-|-
edge|./row{k}|import_alias|Row{k}|Row{k}|1|-|-
call|props.items.map|List{k}|-|-|3|-|open
call|key{k}|props.items.map.<callback>|-|-|3|-|own
""",
    "bash": r"""
symbol|build{k}|function|-|-|4|6|-
symbol|run{k}|function|-|-|7|9|-
edge|./lib{k}.sh|source|-|-|1|-|-
edge|../shared/env{k}.sh|source|-|-|2|-|-
call|compile|build{k}|-|-|5|-|open
call|build{k}|run{k}|-|-|8|-|own
call|run{k}|<module>|-|-|10|-|own
""",
    "c": r"""
symbol|point{k}|struct|-|-|3|3|-
symbol|pair{k}|struct|-|-|4|4|-
symbol|color|class|-|-|5|5|-
symbol|add{k}|function|-|-|6|8|-
symbol|main|function|-|-|9|9|-
edge|audit{k}.h|include|-|-|1|-|-
edge|<stdio.h>|include|-|-|2|-|-
call|add{k}|main|-|-|9|-|own
call|other{k}|main|-|-|9|-|open
""",
    "cpp": r"""
symbol|Shape{k}|class|-|-|2|5|-
symbol|Shape{k}.area|method|-|-|4|4|-
symbol|draw{k}|function|-|-|6|9|-
edge|shape{k}.hpp|include|-|-|1|-|-
edge|Base|base_type|-|Shape{k}|2|-|-
call|side{k}|Shape{k}.area|-|-|4|-|open
call|std.sort|draw{k}|-|-|7|-|open
call|item.show{k}|draw{k}|-|-|8|-|open
""",
    "csharp": r"""
symbol|Svc{k}|class|-|-|5|13|-
symbol|Svc{k}.Inner|class|-|-|6|6|-
symbol|Svc{k}.Inner.Title|variable|-|-|6|6|-
symbol|Svc{k}.Users|variable|-|-|7|7|-
symbol|Svc{k}.Roles|variable|-|-|8|8|-
symbol|Svc{k}.Run{k}|method|-|-|9|12|-
symbol|Ext|class|-|-|14|16|-
symbol|Ext.Twice{k}|method|-|-|15|15|-
edge|System|using|-|-|1|-|-
edge|App.Tool{k}|using_static|-|-|2|-|-
edge|App.Json|using_alias|J{k}|-|3|-|-
edge|App.Core{k}|namespace|-|-|4|-|-
edge|Base|base_type|-|Svc{k}|5|-|-
edge|IThing|base_type|-|Svc{k}|5|-|-
edge|string|property_type|Title|Inner|6|-|-
edge|User{k}|property_type|Users|Svc{k}|7|-|-
edge|Role|property_type|Roles|Svc{k}|8|-|-
edge|User{k}|type_binding|u|*|10|-|-
edge|int|extension_method|Twice{k}|Twice{k}|15|-|-
call|User{k}|Svc{k}.Run{k}|-|-|10|-|open
call|u.Name|Svc{k}.Run{k}|-|-|11|-|open
call|u.Name.Trim|Svc{k}.Run{k}|-|-|11|-|open
""",
    "go": r"""
symbol|Server{k}|struct|-|-|6|6|-
symbol|Store|interface|-|-|7|7|-
symbol|First{k}|constant|-|-|8|11|-
symbol|total{k}|variable|-|-|12|12|-
symbol|Server{k}.Run|method|-|-|13|13|-
symbol|main|function|-|-|14|17|-
symbol|helper{k}|function|-|-|18|18|-
edge|main{k}|package|-|-|1|-|-
edge|fmt|import|fmt|-|3|-|-
edge|x.org/logging|import|log{k}|-|4|-|-
call|s.stop{k}|Server{k}.Run|-|-|13|-|open
call|fmt.Println|main|-|-|15|-|open
call|helper{k}|main|-|-|16|-|own
""",
    "java": r"""
symbol|Svc{k}|class|-|-|5|12|-
symbol|Svc{k}.count{k}|variable|-|-|6|6|-
symbol|Svc{k}.Svc{k}|method|-|-|7|7|-
symbol|Svc{k}.size|method|-|-|8|10|-
symbol|Svc{k}.Part|interface|-|-|11|11|-
edge|a.b{k}|package|-|-|1|-|-
edge|java.util.List|import|List|List|2|-|-
edge|a.tools{k}.*|import|-|-|3|-|-
edge|a.Tool{k}.go|import_static|-|-|4|-|-
edge|Base|base_type|-|Svc{k}|5|-|-
edge|One|base_type|-|Svc{k}|5|-|-
edge|Two|base_type|-|Svc{k}|5|-|-
call|names.size{k}|Svc{k}.size|-|-|9|-|open
call|names.size{k}.intValue|Svc{k}.size|-|-|9|-|open
""",
    "php": r"""
symbol|Svc{k}|class|-|-|5|11|-
symbol|Svc{k}.LIMIT{k}|constant|-|-|6|6|-
symbol|Svc{k}.$x{k}|variable|-|-|7|7|-
symbol|Svc{k}.run|method|-|-|8|10|-
symbol|top{k}|function|-|-|12|12|-
edge|App{k}|namespace|-|-|2|-|-
edge|App\Model\User{k}|use|User{k}|User{k}|3|-|-
edge|App\Model\Role|use|R|Role|3|-|-
edge|App\run{k}|use|run{k}|run{k}|4|-|-
edge|Base|base_type|-|Svc{k}|5|-|-
call|this.go{k}|Svc{k}.run|-|-|9|-|open
call|Tool.make|Svc{k}.run|-|-|9|-|open
call|Svc{k}|top{k}|-|-|12|-|open
""",
    "ruby": r"""
symbol|App{k}|class|-|-|3|10|-
symbol|App{k}.Svc|class|-|-|4|9|-
symbol|App{k}.Svc.LIMIT_{k}|constant|-|-|5|5|-
symbol|App{k}.Svc.run|method|-|-|6|8|-
edge|json|require|-|-|1|-|-
edge|lib/my_tool{k}|require_relative|MyTool{k}|*|2|-|-
edge|Base|base_type|-|Svc|4|-|-
call|MyTool{k}.go|App{k}.Svc.run|-|-|7|-|open
""",
    "rust": r"""
symbol|P{k}|struct|-|-|4|4|-
symbol|Show|interface|-|-|5|5|-
symbol|Show.show|method|-|-|5|5|-
symbol|P{k}.show|method|-|-|7|7|-
symbol|MAX_{k}|constant|-|-|9|9|-
symbol|main|function|-|-|10|14|-
edge|util{k}|mod|util{k}|*|1|-|-
edge|crate::a{k}::b::C|use|C|C|2|-|-
edge|crate::a{k}::d|use|e|d|2|-|-
edge|crate::a{k}|use|a{k}|a{k}|2|-|-
edge|super::x{k}|rust_reexport|-|*|3|-|-
edge|Show|base_type|-|P{k}|6|-|-
call|self.n.help{k}|P{k}.show|-|-|7|-|open
call|util{k}.run|main|-|-|11|-|open
call|println|main|-|-|12|-|open
call|P{k}.new|main|-|-|13|-|open
call|P{k}.new.build|main|-|-|13|-|open
""",
}
