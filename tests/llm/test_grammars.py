"""Whole files and broken statements per language (problem 2)."""

import pytest

from codeloom.llm.syntax import failure

GOOD = {
    ".java": '''package a.b;
import java.util.*;
import static x.Y.z;
@FunctionalInterface
public interface Op<T extends Comparable<T> & Runnable> { T run(T a, int... more) throws E1, E2; default int n() { return 1; } int[] dims()[]; }
sealed class P permits Q {}
@interface Note { String value() default "x"; int[] ids() default {1, 2,}; }
enum Color implements Op { RED(1) { void f() {} }, @Deprecated GREEN; private final int c = 0; Color() {} }
record Point(int x, @Note("a") int y) { Point { if (x < 0) throw new IllegalArgumentException("x" + x); } static int k = 3; }
public class A<K, V> extends B<K> implements C, D<V> {
  private static final Map<String, List<Map<K, int[]>>> m = new HashMap<>() {{ put("a", List.of()); }};
  static { int a[] = {1, 2}, b = 3; }
  A() { super(); this.x = y; }
  <R> R f(final List<? super R> in, R... rest) {
    for (int i = 0, j = 1; i < 10 && j >> 2 > 0; i++, j--) { continue; }
    outer: for (var e : in) { if (e instanceof Foo f && f.ok()) break outer; else continue; }
    int[][] g = new int[3][], h = new int[][] {{1}, {2}};
    Runnable r = () -> {}; Function<Integer, Integer> q = (a) -> a + 1; BiFunction<A, B, C> w = (int a, B b) -> { return null; };
    Supplier<List<String>> s = ArrayList<String>::new; IntFunction<int[]> t = int[]::new; Object o = (Runnable & Foo) () -> go(); long l = (long) -1 + (x) + ~y;
    try (var in2 = open(); out) { x = y ? z : w; } catch (A | B ex) { throw ex; } finally { synchronized (this) { i >>>= 1; } }
    switch (k) { case 1: case 2: go(); break; default: stop(); }
    String u = switch (k) { case A, B -> "x"; case Point(int x, var y) when x > 0 -> { yield "z"; } default -> throw new E(); };
    do { i++; } while (i < 3);
    assert i > 0 : "no"; int.class.getName(); A.super.f(); a.<String>b(c).d[1].e++; Outer.Inner in3 = o.new Inner();
    return cond ? (a, b) -> a : null;
  }
}
''',
    ".go": '''package main

import (
	"fmt"
	m "math"
	_ "x"
)

type (
	A struct {
		B, C int `json:"b"`
		*sync.Mutex
		f func(a, b int, c ...string) (x int, err error)
	}
	I interface {
		io.Reader
		M(a int) error
		~int | ~string
	}
	List[T any] struct{ next *List[T] }
)

const (
	x = iota
	y
	z float64 = 1 << 3
)

var a, b = 1, 2
var c map[string][]chan<- int

func Map[T, U any](in []T, f func(T) U) (out []U) {
	for i, v := range in {
		out = append(out, f(v))
		_ = i
	}
	for i := 0; i < 10; i++ {
	}
	for {
		break
	}
	if v, ok := c["a"]; !ok && v == nil {
		return nil
	} else if x := f(1); x != (T{1}) {
		goto end
	}
	switch t := v.(type) {
	case nil, *A:
		fallthrough
	default:
	}
	switch {
	case a < b:
		go func() { defer close(ch) }()
	}
	select {
	case v := <-ch:
	case ch <- 1:
	default:
	}
	s := []A{{B: 1}, {2, 3}}
	p := &A{
		B: 1,
	}
	q := map[string]struct{ a int }{"x": {1}}
	r := s[1:2:3]
	fmt.Println(r[:], []byte("a"), make([]int, 3), func(a int) int { return -a }(1), *p, q...)
	a, b = b, a&^1
end:
	return
}

func (s *List[T]) Len() int { return 0 }
''',
    ".rs": '''#![allow(dead_code)]
use std::{collections::HashMap as M, fmt::{self, *}};
pub(crate) mod a { pub use super::*; }
extern crate x;
#[derive(Debug, Clone)]
pub struct S<'a, T: Clone + 'a = u8, const N: usize = 3> where T: Fn(u8) -> u8 { pub a: &'a mut [T; N], b: Box<dyn Fn(&str) -> Vec<Vec<u8>> + Send> }
struct U; struct P(pub u8, u16);
enum E { A = 1, B { x: i32 }, C(u8), }
union W { a: u8, b: f32 }
static mut G: u8 = 0; const K: &[u8] = b"x";
type R<T> = Result<T, Box<dyn std::error::Error>>;
macro_rules! m { (a) => { b }; }
unsafe impl<T> Send for S<'_, T> {}
trait Tr: Clone { type Item: Copy; const Q: u8; fn f(&self) -> Self::Item; fn g(self: Box<Self>, _: u8) where Self: Sized {} }
impl<'a, T> S<'a, T> where T: Clone {
    pub async unsafe fn go<F>(&mut self, mut f: F, (a, b): (u8, u16)) -> impl Iterator<Item = u8> + '_ where F: FnMut(u8) -> u8 {
        let x: u8 = if let Some(y) = f(1) && y > 2 { 3 } else if a as u16 == b { 4 } else { 5 };
        let Some(z) = w else { return Err(e)?; };
        'l: loop { break 'l; }
        while let Some(i) = it.next() { continue; }
        for (i, c) in (0..10).rev().enumerate() { v[i] += c << 2; }
        match x { 0 => {} 1 | 2 if a => (), 3..=9 => go(), E::B { x, .. } => { y } S { a: ref q @ 1..=2, b } => return, _ => unreachable!("{}", x), }
        let c = move |a, &b: &u8| -> u8 { a + b }; let d = || 1;
        let p = P { 0: 1, ..Default::default() }; let q = [0u8; 4]; let t = (1,);
        vec![1, 2].iter().map(|x| x * 2).collect::<Vec<_>>()?.len(); println!("{}", !a && -b < *c);
        unsafe { *p = 1 } ; let r = &mut x.0.y; a?.b?; <T as Tr>::f(&x); Vec::<u8>::new(); x..; ..=y;
        async move { z.await? }
    }
}
''',
    ".cpp": '''#include <vector>
#define MAX(a, b) \\
  ((a) > (b) ? "x" : b)
namespace a::b { class F; }
using namespace std;
using V = std::vector<std::pair<int, std::string>>;
template <typename T, int N = 3, typename... Ts> class C : public B<T>, private virtual D {
public:
  explicit C(int a, const std::string &s = "x") : B<T>(a), s_{s}, n(0) {}
  virtual ~C() = default;
  C(const C &) = delete;
  C &operator=(C &&o) noexcept;
  bool operator()(int x) const override { return x < n && !s_.empty(); }
  T *get() const { return ptr_; }
  static constexpr int k = 1 << 3;
  enum class E : unsigned { A = 1, B, };
  friend class F;
private:
  std::map<std::string, std::vector<int>> m_; int n = 0, *p, a[3] = {1, 2, 3}; unsigned long long u : 4;
};
typedef struct { int a; unsigned char b[4]; } S;
typedef int (*fn)(const char *, ...);
extern "C" { int f(void); }
static inline const char *name(int i) { return i ? "a" "b" : nullptr; }
template <> struct H<int> { size_t operator()(const int &x) const; };
std::ostream &operator<<(std::ostream &os, const S &s) { return os << s.a << '\\n'; }
auto g(int x) -> int { return x; }
int main(int argc, char **argv) {
  for (auto &x : v) { x += 1; } for (int i = 0, j = 9; i < j; ++i, --j) continue;
  auto l = [&, this](int a) mutable -> int { return a * 2; }; l(1); std::sort(v.begin(), v.end(), [](auto a, auto b) { return a > b; });
  if (auto it = m.find(k); it != m.end()) { delete[] p; } else if (!(x & 1)) goto end;
  switch (x) { case 1: { break; } case A::B: f(); default: ; }
  try { throw std::runtime_error("x"); } catch (const std::exception &e) { } catch (...) { throw; }
  do { (*p)++; } while (p->next && (int)x > -1);
  struct S s = { .a = 1, .b = {0} }; S *q = (S *)malloc(sizeof(S) * n); int *r = new int[3]; T t{1, 2}; std::unique_ptr<A> w(new A(1)); static_cast<int>(3.0f);
  unsigned x2 = (unsigned)y, z = ~x2; x = y ? a : b, c = d; A<B<int>> ab; int (*fp)(int) = &h; const auto n2 = sizeof x; std::string s2("a"); a.b->c[1](2);
end:
  return 0;
}
''',
}
BAD = {
    ".java": ["class A { void f() { int x = 1 } }", "class A { void f() { g(1; } }", "class A { int x = ; }", "class A { void f() { if x > 1 { } } }", "class A { void f() { return a b; } }", "class A { void f() { for (int i = 0; i < 3) { } } }", "class A {\n=======\n}", "class A { void f() { x = 1 +; } }", "clas A { }"],
    ".go": ["package a\nfunc f() {\n\tx := 1 +\n}\n", "package a\nfunc f() {\n\tif x > 1 \n\t{\n\t}\n}\n", "package a\nfunc f() {\n\tg(1, 2\n}\n", "package a\nfunc f() {\n\treturn a b\n}\n", "func f() {}\n", "package a\nvar x =\n", "package a\nfunc f() {\n>>>>>>> main\n}\n", "package a\nx := 1\n"],
    ".rs": ["fn f() { let x = ; }", "fn f() { g(1; }", "fn f() { let x = 1 let y = 2; }", "fn f( { }", "fn f() { a b }", "fn f() { match x { 1 > 2 } }", "fn f() {\n=======\n}", "struct A { a u8 }"],
    ".cpp": ["int f() { return 1 }", "int f() { g(1; }", "int f() { int x = ; }", "class A { int x; }", "int f() { if (x { } }", "int f() { a b c; }", "int f() {\n>>>>>>> main\n}", "int f() { for (int i = 0; i < 3) { } }", "int f() { x = 1 +; }"],
}


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_a_rich_file_parses(ext):
    assert failure(GOOD[ext], ext) is None


@pytest.mark.parametrize("ext,text", [(e, t) for e in sorted(BAD) for t in BAD[e]])
def test_a_broken_statement_does_not(ext, text):
    assert failure(text, ext) is not None


@pytest.mark.parametrize("ext", sorted(GOOD))
def test_a_truncated_file_does_not(ext):
    text = GOOD[ext].rstrip()
    assert failure(text[: len(text) - 1], ext) is not None or ext == ".go"
